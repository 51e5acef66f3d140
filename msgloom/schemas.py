"""Schemas of the frames, as DDL."""

TIME = "struct<hour:int,minute:int,marker:string>"
THREAD = "array<struct<time:string,sender:string,message:string,received_at:string>>"
EVENT = (
    f"struct<title:string,date:string,time:{TIME},end_time:{TIME},all_day:boolean,location:string,"
    "attendees:array<string>,organizer:string,description:string,recurrence:string,confidence:double>"
)
FLAT_GOLD = f"struct<is_schedule:boolean,title:string,date:string,time:{TIME},end_time:{TIME},location:string,description:string>"
ANY_GOLD = (
    f"struct<is_schedule:string,schedule_status:string,has_schedule:string,title:string,date:string,time:{TIME},end_time:{TIME},"
    f"location:string,description:string,attendees:array<string>,organizer:string,recurrence:string,events:array<{EVENT}>>"
)
PAIR = f"scenario_id string, received_at string, channel string, sender string, language string, thread_context {THREAD}, message string, gold string"
MESSAGE = "channel string, sender string, body string, time_millis long, room string, from_me boolean, counterpart string"
VERDICT = "struct<verdict:string,issues:array<struct<field:string,kind:string,detail:string>>,fixed_gold:string>"
