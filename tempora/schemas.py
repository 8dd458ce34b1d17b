"""Schemas of the data model, as Spark DDL."""

VIDEOS = "video_id string, fps double, width int, height int, frame_count int, duration double"
DETECTIONS = "video_id string, frame_idx int, timestamp double, det_idx int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int"
TRACK_POINTS = "video_id string, track_id int, frame_idx int, timestamp double, pos_x double, pos_y double, confidence double, is_interpolated boolean"
TRACK_STATES = "video_id string, track_id int, state string, hits int, inactive int, pred_x double, pred_y double, vel_x double, vel_y double, size_w double, size_h double"
FRAME_FEATURES = "video_id string, frame_idx int, timestamp double, num_detections int, num_active_tracks int, mean_velocity_y double, std_velocity_y double"
SEGMENTS = "video_id string, segment_id int, start_time double, end_time double, confidence double"
EVENTS = "video_id string, segment_id int, timestamp double, track_id int, confidence double, event_type string"
RUNS = "video_id string, segment_id int, run_id int, start_time double, end_time double, throw_count int"
USERS = "user_id string, name string, email string"
SESSIONS = "session_uuid string, user_id string, start_time double, end_time double"
HISTORY = "timestamp double, total_throws long, duration_seconds double"
SIGNATURE_SAMPLES = "label string, class_id int, color array<float>, texture array<float>"
COMMANDS = "ts timestamp, text string"
ANALYSIS = (
    "video_id string, video_metadata struct<fps:double,width:int,height:int,frame_count:int,duration:double>,"
    " segments array<struct<segment:struct<start_time:double,end_time:double,confidence:double>,"
    "throws array<struct<timestamp:double,track_id:int,confidence:double,event_type:string>>,"
    "runs array<struct<start_time:double,end_time:double,throw_count:int>>,total_throws:int,total_peaks:int>>,"
    " tracks array<struct<id:int,points:array<struct<frame_idx:int,timestamp:double,pos_x:double,pos_y:double,confidence:double,is_interpolated:boolean>>>>,"
    " runs array<struct<start_time:double,end_time:double,throw_count:int>>"
).replace("throws array<", "throws:array<").replace("runs array<struct<start_time:double,end_time:double,throw_count:int>>,total", "runs:array<struct<start_time:double,end_time:double,throw_count:int>>,total")
