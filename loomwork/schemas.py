"""Schemas of the crosswalk's tables as DDL, which readers take as it is; ``struct`` parses one."""

from __future__ import annotations

from pyspark.sql.types import StructType

FRAMEWORKS = "id string, name string, version string, fetch_date string, control_count int"
CONTROLS = "id string, framework_id string, section_id string, title string, description string, full_text string"
HUBS = "id string, name string, path string, parent_id string, depth int, branch_root_id string, is_leaf boolean"
ASSIGNMENTS = (
    "id bigint, control_id string, hub_id string, confidence double, in_conformal_set boolean, is_ood boolean, provenance string, source_link_id string, "
    "model_version string, review_status string, reviewer string, review_date string, reviewer_notes string, original_hub_id string, created_at timestamp"
)
SNAPSHOTS = "id bigint, round_number int, snapshot_date timestamp, db_hash string, description string"
HUB_LINKS = "cre_id string, cre_name string, standard_name string, section_id string, section_name string, link_type string, framework_id string"
EMBEDDINGS = "kind string, id string, framework_id string, embedding array<float>"
SIMILARITIES = "item_id string, hub_id string, sim double"
FRAMEWORK_DOCUMENT = (
    "framework_id string, framework_name string, version string, source_url string, fetched_date string, mapping_unit_level string, "
    "controls array<struct<control_id:string,title:string,description:string,full_text:string,hierarchy_level:string,parent_id:string,parent_name:string,"
    "metadata:map<string,string>>>"
)
TAXONOMY_DUMP = (
    "cres array<struct<doctype:string,id:string,name:string,tags:array<string>,"
    "links:array<struct<ltype:string,document:struct<doctype:string,id:string,name:string,sectionID:string,section:string,tags:array<string>>>>>>"
)
#: Ground truth first, then the newest kind of review.
GROUND_TRUTH = ("ground_truth", "ground_truth_ai")
EXPORTABLE_STATUS = "accepted"
IN_SCOPE_STATUSES = ("accepted", "ground_truth")


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def conform(df, ddl: str):
    """``df`` with the schema's columns in order: missing ones null, others left out.

    Adding a column to a table is adding it to its schema; old files read as null.
    """
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(ddl)])
