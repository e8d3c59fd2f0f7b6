"""Enum names, vocabularies, groups and thresholds that results must agree with."""

# Object, vehicle and traffic-light enums of the open simulation interface.
OBJECT_TYPES = ["TYPE_UNKNOWN", "TYPE_OTHER", "TYPE_VEHICLE", "TYPE_PEDESTRIAN", "TYPE_ANIMAL"]
VEHICLE_SUBTYPES = [
    "TYPE_UNKNOWN", "TYPE_OTHER", "TYPE_SMALL_CAR", "TYPE_COMPACT_CAR", "TYPE_CAR", "TYPE_LUXURY_CAR",
    "TYPE_VAN", "TYPE_HEAVY_TRUCK", "TYPE_SEMITRAILER", "TYPE_TRAILER", "TYPE_MOTORCYCLE",
    "TYPE_BICYCLE", "TYPE_BUS", "TYPE_TRAM", "TYPE_TRAIN", "TYPE_WHEELCHAIR", "TYPE_SEMITRACTOR",
    "TYPE_STANDUP_SCOOTER", "TYPE_MICROMOBILITY_DEVICE", "TYPE_WORK_MACHINE", "TYPE_WATERCRAFT",
    "TYPE_AIRCRAFT", "TYPE_LAND_VEHICLE",
]
VEHICLE_ROLES = [
    "ROLE_UNKNOWN", "ROLE_OTHER", "ROLE_CIVIL", "ROLE_AMBULANCE", "ROLE_FIRE", "ROLE_POLICE",
    "ROLE_PUBLIC_TRANSPORT", "ROLE_ROAD_ASSISTANCE", "ROLE_GARBAGE_COLLECTION",
    "ROLE_ROAD_CONSTRUCTION", "ROLE_MILITARY",
]
LIGHT_COLORS = ["COLOR_UNKNOWN", "COLOR_OTHER", "COLOR_RED", "COLOR_YELLOW", "COLOR_GREEN", "COLOR_BLUE", "COLOR_WHITE"]
LIGHT_MODES = ["MODE_UNKNOWN", "MODE_OTHER", "MODE_OFF", "MODE_CONSTANT", "MODE_FLASHING", "MODE_COUNTING"]
LIGHT_ICONS = [
    "ICON_UNKNOWN", "ICON_OTHER", "ICON_NONE", "ICON_ARROW_STRAIGHT_AHEAD", "ICON_ARROW_LEFT",
    "ICON_ARROW_DIAG_LEFT", "ICON_ARROW_STRAIGHT_AHEAD_LEFT", "ICON_ARROW_RIGHT",
    "ICON_ARROW_DIAG_RIGHT", "ICON_ARROW_STRAIGHT_AHEAD_RIGHT", "ICON_ARROW_LEFT_RIGHT",
    "ICON_ARROW_DOWN", "ICON_ARROW_DOWN_LEFT", "ICON_ARROW_DOWN_RIGHT", "ICON_ARROW_CROSS",
    "ICON_PEDESTRIAN", "ICON_WALK", "ICON_DONT_WALK", "ICON_BICYCLE", "ICON_PEDESTRIAN_AND_BICYCLE",
    "ICON_COUNTDOWN_SECONDS", "ICON_COUNTDOWN_PERCENT", "ICON_TRAM", "ICON_BUS", "ICON_BUS_AND_TRAM",
]

# Labels that exporting pipelines write.
PIPELINE_TYPES = ["OTHER", "VEHICLE", "PEDESTRIAN", "ANIMAL"]
PIPELINE_SUBTYPES = [
    "OTHER", "SMALL_CAR", "COMPACT_CAR", "CAR", "MEDIUM_CAR", "LUXURY_CAR", "DELIVERY_VAN",
    "HEAVY_TRUCK", "BUS", "COACH", "TRAILER", "MOTORBIKE", "CYCLIST", "BICYCLE", "POLICE_CAR",
    "AMBULANCE", "FIRE_TRUCK",
]
PIPELINE_ROLES = ["OTHER", "CIVILIAN", "AMBULANCE", "FIRE", "POLICE", "PUBLIC_TRANSPORT", "MOVING"]

# Columns of a trajectory log, and fields of its header.
HEADER_FIELDS = ["country_code", "proj_string", "host_vehicle_id", "version"]
LOG_COLUMNS = [
    "total_nanos", "idx", "x", "y", "z", "vel_x", "vel_y", "vel_z", "acc_x", "acc_y", "acc_z",
    "length", "width", "height", "roll", "pitch", "yaw", "type", "subtype", "role",
]
ANGLE_COLUMNS = ["roll", "pitch", "yaw"]
SIZE_COLUMNS = ["length", "width", "height"]

# Coarse vehicle groups by subtype code and by label.
GROUP_OF_SUBTYPE = {2: "car", 3: "car", 4: "car", 5: "car", 6: "van", 7: "truck", 8: "truck", 9: "truck", 10: "motorcycle", 11: "bicycle", 12: "bus", 13: "bus", 14: "bus"}
GROUP_OF_LABEL = {"car": "car", "vehicle": "car", "van": "van", "truck": "truck", "trailer": "truck", "bus": "bus", "motorcycle": "motorcycle", "bicycle": "bicycle"}

# Level of service by control delay, seconds per vehicle.
DELAY_GRADES = [["A", 10], ["B", 15], ["C", 25], ["D", 35], ["E", 50], ["F", 1e9]]

# Thresholds of the dataset summary and labels of its reports.
VIDEO_WARN_BELOW = {"tds": 95.0, "tcomp": 95.0, "dup": 99.0, "sci": 70.0, "blk": 70.0, "fov": 70.0}
VIDEO_LABELS = {"tds": "TDS", "tcomp": "Temporal Completeness", "dup": "Unique Record Rate", "sci": "SCI", "blk": "Partial Blockage", "fov": "FOV Stability"}
LOG_LABELS = {
    "attr": "Attribute Completeness", "rec": "Record Completeness", "fmt": "Format Consistency",
    "dup": "Duplicate Rate", "tcomp": "Temporal Completeness", "cls_pct": "Class Diversity",
    "traj_pct": "Trajectory Plausibility",
}
LOG_FLAGS = {"rec_ok": "Rec", "fmt_ok": "Fmt", "dup_ok": "Dup", "tcomp_ok": "TComp"}
OFFICIAL_VIDEO_LABELS = {
    "tcomp": "Temporal Completeness", "dup": "Unique Record Rate", "sci": "Sensor Consistency",
    "tds": "Temporal Distortion Score [custom]", "blk": "Partial Blockage [custom]",
    "fov": "FOV Stability [custom]",
}
OFFICIAL_LOG_LABELS = {
    "attr": "Attribute Completeness", "rec": "Record Completeness", "fmt": "Data Format Consistency",
    "dup": "Duplicate Record Rate", "tcomp": "Temporal Completeness", "cls_pct": "Class Diversity",
    "traj_pct": "Trajectory Plausibility [custom]",
}
OFFICIAL_FLAGS = {
    "attr_ok": "Attr", "rec_ok": "Rec", "cls": "Cls", "fmt_ok": "Fmt", "dup_ok": "Dup",
    "tcomp_ok": "TComp", "obj_cov": "ObjCov", "traj": "Traj", "fmeta": "FileMeta",
}
LOG_PASS_OF = {
    "attr": ("attr_ok", "=100%"), "rec": ("rec_ok", "≥95%"), "fmt": ("fmt_ok", "≥95%"),
    "dup": ("dup_ok", "≤1%"), "tcomp": ("tcomp_ok", "≥98%"), "cls_pct": ("cls", "≥2 per field"),
    "traj_pct": ("traj", "≤2% implaus."),
}
# fixed values: lines of the log table that only pass or fail, and the columns of its rows by file
LOG_PASS_ONLY = {"fmeta": ("File Metadata [custom]", "—")}
LOG_FILE_COLUMNS = {"attr": "Attr%", "rec": "Rec%", "fmt": "Fmt%", "dup": "Dup%", "tcomp": "TComp%"}
OFFICIAL_TICKS = {"cls": "Cls", "obj_cov": "ObjCov", "traj": "Traj", "fmeta": "FilM"}
VIDEO_FILE_COLUMNS = {"tds": "TDS%", "tcomp": "TComp%", "dup": "Uniq%", "sci": "SCI%", "blk": "Blk%", "fov": "FOV%"}
