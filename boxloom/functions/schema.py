"""Schemas of the tables that pass between the pipelines. Nothing is inferred."""

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
SIZE = "struct<width:int,height:int>"
DETECTIONS = "array<struct<bbox_2d:array<int>>>"
IMAGE_REF = "struct<source:string,path:string,width:int,height:int,boxes_xyxy:array<array<int>>>"
RECORD = (
    "schema_version int, id string, split string, group_id string, visual_concept string, query string, "
    f"positive boolean, reference {IMAGE_REF}, target {IMAGE_REF}, detection_set {DETECTIONS}"
)
PREDICTION = "id string, raw_completion string"
IMAGE = (
    "record_id string, source string, stem string, path string, width int, height int, content_sha256 string, "
    "group_key string, objects array<struct<concept:string,box:array<int>>>"
)
SPLITS = ("train", "validation", "test")
