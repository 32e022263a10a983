"""Explicit read schemas; no inference pass over the files."""

WORD = "struct<start:double,end:double,word:string>"
SEGMENT = f"struct<start:double,end:double,text:string,speaker:string,confidence:double,avg_logprob:double,no_speech_prob:double,words:array<{WORD}>>"
SCENE = ("struct<timestamp:double,description:string,importance_score:int,subject_x:int,active_speaker_x:int,"
         "subject_box:array<double>,has_screen_content:boolean>")
CLIP = ("struct<id:int,title:string,start_time:double,end_time:double,duration:double,viral_score:int,hook_score:int,flow_score:int,"
        "value_score:int,trend_score:int,clip_focus:string,focus_relevance:int,platform:string,clip_type:string>")
JOB = (
    "job_id string, filename string, status string, progress double, progress_message string, created_at string, updated_at string, "
    "owner_user_id string, owner_username string, duration double, file_size_mb double, estimated_cost_usd double, "
    f"provider_used map<string,string>, timings map<string,double>, speaker_names map<string,string>, transcript array<{SEGMENT}>, "
    f"scenes array<{SCENE}>, clips array<{CLIP}>, _corrupt_record string"
)
LEXICON = "version string, entries array<struct<phrase:string,genres:array<string>,platforms:array<string>,hotness:string>>"
TRAJECTORY = ("t double, cx double, cy double, w double, h double, subject_cx double, subject_cy double, "
              "n_subjects_in_crop int, is_split_screen boolean")
TIMELINE = ("events array<struct<frame:bigint,t:double,crop_cx:double,crop_cy:double,crop_w:double,crop_h:double,scene_change:boolean>>, "
            "_corrupt_record string")
MANIFEST = ("clips array<struct<slug:string,source_url:string,sha256:string,ext:string,duration_sec:int,content_type:string,subtype:string,"
            "target_clipcontenttype:string,description:string,ground_truth_vertical_url:string>>")
