"""Gold sets: nested JSON with rules that hold across its rows, all checked in one pass over each data set's own arrays.

Defined cases: JSON that does not parse as the schema fails the read (FAILFAST); a list that
is missing counts as empty; of page summaries with one page the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ANNOTATION = "id string, page int, bbox array<double>, review_status string"
SCHEMA = (
    "schema_version string, dataset_id string, coordinate_space string, source struct<filename:string,sha256:string,selected_pages:array<int>>, approval struct<status:string,reviewer_name:string,reviewed_at:string>, "
    "candidate_provenance array<string>, page_summaries array<struct<page:int,table_count:int,checkbox_count:int>>, "
    f"tables array<struct<{_ANNOTATION}, semantic_role string, expected_rows int, expected_columns int, expected_cells int, row_cell_counts array<int>>>, checkboxes array<struct<{_ANNOTATION}, group string, label string, state string>>, "
    "rejected_checkbox_candidates array<struct<id string, page int, source string, reason string, review_status string>>, notes array<string>"
)
#: Version, coordinates, states of review and of checkboxes.
VERSION, SPACE, PENDING, APPROVED, STATES = "1.0", "normalized_top_left_xyxy", "pending_human_review", "human_approved", ("checked", "unchecked")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """The data sets of JSON files, one a file."""
    return spark.read.schema(SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def parsed_gold(text: Column) -> Column:
    return F.from_json(text, SCHEMA, {"mode": "FAILFAST"})


def gold_faults(sets: DataFrame, *keep: str, require_approval: bool = False) -> DataFrame:
    """(keep, rule, subject): every rule that a data set breaks, with the page, id or field that breaks it. With ``require_approval`` a set
    that no person has approved is a fault too."""
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    kinds = {f.name: f.dataType.simpleString() for f in sets.schema}
    pages = F.coalesce(F.col("source.selected_pages"), F.array().cast("array<int>"))
    tables, boxes, rejected, summaries = (empty(c, kinds[c]) for c in ("tables", "checkboxes", "rejected_checkbox_candidates", "page_summaries"))
    short = lambda a: F.transform(a, lambda x: F.struct(x["id"], x["page"], x["review_status"]))
    x = sets.withColumns({"_pages": pages, "_tables": tables, "_boxes": boxes, "_rejected": rejected, "_summaries": summaries})
    x = x.withColumn("_all", F.concat(short(F.col("_tables")), short(F.col("_boxes")), short(F.col("_rejected"))))
    p, t, c, s, every = (F.col(k) for k in ("_pages", "_tables", "_boxes", "_summaries", "_all"))

    ids = lambda a, wrong: F.transform(F.filter(a, lambda x: F.coalesce(wrong(x), F.lit(True))), lambda x: F.coalesce(x["id"], F.lit("")))
    text = lambda a: F.transform(a, lambda x: x.cast("string"))
    repeated = lambda a: F.array_distinct(F.filter(a, lambda x: F.size(F.filter(a, lambda y: y == x)) > 1))
    covered = F.transform(s, lambda x: x["page"])
    last = F.filter(s, lambda x, i: ~F.exists(F.slice(s, i + 2, F.size(s)), lambda y: y["page"] == x["page"]))
    miscounted = lambda a, field: F.transform(F.filter(last, lambda x: x[field] != F.size(F.filter(a, lambda y: y["page"] == x["page"]))), lambda x: x["page"].cast("string"))
    off = lambda b: ~((F.size(b) == 4) & F.forall(b, lambda v: v.between(0, 1)) & (F.get(b, 0) < F.get(b, 2)) & (F.get(b, 1) < F.get(b, 3)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, v: n + v)
    blank = lambda v: F.coalesce(v, F.lit("")) == ""
    approval, approved = F.col("approval"), F.col("approval.status") == APPROVED
    only = lambda cond, subject: F.when(F.coalesce(cond, F.lit(True)), F.array(F.lit(subject)))
    known = lambda v: v.isin(PENDING, APPROVED)
    rules = {
        "repeated_page": text(repeated(p)), "uncovered_page": text(F.array_distinct(F.concat(F.array_except(p, covered), F.array_except(covered, p)))), "page_not_selected": ids(every, lambda a: ~F.array_contains(p, a["page"])),
        "repeated_id": repeated(F.transform(every, lambda a: a["id"])), "table_count": miscounted(t, "table_count"), "checkbox_count": miscounted(c, "checkbox_count"),
        "unapproved_annotation": F.when(approved, ids(every, lambda a: a["review_status"] != APPROVED)), "no_reviewer": F.when(approved, only((F.trim(F.coalesce("approval.reviewer_name", F.lit(""))) == "") | F.col("approval.reviewed_at").try_cast("timestamp").isNull(), "approval")),
        "invalid_box": F.concat(ids(t, lambda a: off(a["bbox"])), ids(c, lambda a: off(a["bbox"]))), "row_count_length": ids(t, lambda a: F.size(a["row_cell_counts"]) != a["expected_rows"]), "row_count_sum": ids(t, lambda a: total(a["row_cell_counts"]) != a["expected_cells"]),
        "row_count_range": ids(t, lambda a: F.exists(a["row_cell_counts"], lambda n: (n < 1) | (n > a["expected_columns"]))),
        "invalid_value": F.concat(
            *(F.coalesce(only(cond, name), F.array().cast("array<string>")) for cond, name in (
                (F.col("schema_version") != VERSION, "schema_version"), (blank(F.col("dataset_id")), "dataset_id"), (F.col("coordinate_space") != SPACE, "coordinate_space"), (~F.col("source.sha256").rlike("^[0-9a-f]{64}$"), "sha256"), (F.size(p) == 0, "selected_pages"),
                (~known(approval["status"]), "approval"), (F.size(F.coalesce("candidate_provenance", F.array())) == 0, "candidate_provenance"), (F.exists(s, lambda y: (y["page"] < 1) | (y["table_count"] < 0) | (y["checkbox_count"] < 0)), "page_summaries"),
            )),
            ids(every, lambda a: blank(a["id"]) | (a["page"] < 1) | ~known(a["review_status"])), ids(t, lambda a: blank(a["semantic_role"]) | (a["expected_rows"] < 1) | (a["expected_columns"] < 1) | (a["expected_cells"] < 1)),
            ids(c, lambda a: blank(a["group"]) | blank(a["label"]) | ~a["state"].isin(*STATES)), ids(F.col("_rejected"), lambda a: blank(a["source"]) | blank(a["reason"])),
        ),
        **({"not_approved": only(~approved, "approval")} if require_approval else {}),
    }

    def told(rule: str, subjects: Column) -> Column:
        return F.transform(F.coalesce(subjects, F.array().cast("array<string>")), lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("subject")))

    return x.select(*keep, F.explode(F.concat(*(told(*r) for r in rules.items()))).alias("f")).select(*keep, "f.rule", "f.subject")
