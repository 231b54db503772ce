"""Checks over JSON columns: project configurations and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteatlas.functions import text as X
from siteatlas.functions import urls as U

# ---- fixed values -----------------------------------------------------------
AUTH_TYPES = ["none", "email_password", "session", "oauth"]
OUTPUT_FORMATS = ["markdown", "html", "pdf", "word"]
# -----------------------------------------------------------------------------

CONFIG_SCHEMA = """name string, baseUrl string,
  scope struct<maxDepth: double, maxPages: double>,
  auth struct<type: string, email: string, password: string, sessionCookies: map<string, string>>,
  output struct<formats: array<string>, outputDir: string>"""
ANSWER_SCHEMA = """page_purpose string, target_users array<string>,
  elements array<struct<selector: string, description: string, user_action: string>>,
  steps array<string>, common_issues array<string>"""
ANSWER_REQUIRED = ["page_purpose", "elements", "steps"]


def config_violations(projects: DataFrame) -> DataFrame:
    """(project_id, violation): one row per broken rule of a project's JSON config."""
    c = F.from_json("config", CONFIG_SCHEMA)
    url = F.coalesce(c["baseUrl"], F.lit(""))
    kind = F.coalesce(X.trimmed(c["auth"]["type"]), F.lit("none"))
    by_mail = c["auth"].isNotNull() & (kind == "email_password")
    email = F.coalesce(c["auth"]["email"], F.lit(""))

    def out_of(column, low: int, high: int):
        return column.isNotNull() & ((column < low) | (column > high))

    rules = F.array(
        F.when(F.coalesce(c["name"], F.lit("")) == "", F.lit("name is required")),
        F.when(url == "", F.lit("base_url is required"))
        .when(~U.is_valid(url), F.concat(F.lit("Invalid URL: "), url))
        .when(~U.is_http(url), F.concat(F.lit("Invalid URL scheme: "), U.scheme(url), F.lit(":. Must be http or https."))),
        F.when(out_of(c["scope"]["maxDepth"], 1, 20), F.lit("max_depth must be an integer between 1 and 20")),
        F.when(out_of(c["scope"]["maxPages"], 1, 1000), F.lit("max_pages must be an integer between 1 and 1000")),
        F.when(c["auth"].isNotNull() & ~kind.isin(AUTH_TYPES), F.concat(
            F.lit("Invalid auth type: "), kind, F.lit(f". Must be one of: {', '.join(AUTH_TYPES)}"))),
        F.when(by_mail & (email == ""), F.lit("email is required for email_password auth")),
        F.when(by_mail & (F.coalesce(c["auth"]["password"], F.lit("")) == ""),
               F.lit("password is required for email_password auth")),
        F.when(by_mail & (email != "") & ~email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
               F.concat(F.lit("Invalid email format: "), email)),
        F.when((kind == "session") & c["auth"].isNotNull()
               & (F.coalesce(F.cardinality(c["auth"]["sessionCookies"]), F.lit(0)) <= 0),
               F.lit("session_cookies is required for session auth")),
        F.when(c["output"]["outputDir"] == "", F.lit("output_dir must be a non-empty string")))
    formats = F.transform(
        F.filter(F.coalesce(c["output"]["formats"], F.array().cast("array<string>")), lambda f: ~f.isin(OUTPUT_FORMATS)),
        lambda f: F.concat(F.lit("Invalid output format: "), f, F.lit(f". Must be one of: {', '.join(OUTPUT_FORMATS)}")))
    return projects.select("project_id", F.explode(F.concat(F.array_compact(rules), formats)).alias("violation"))


def validated_answers(answers: DataFrame, column: str) -> DataFrame:
    """Parse the JSON inside an answer; add its fields, defaults and missing names."""
    parsed = answers.withColumn("_j", F.from_json(X.outermost_json(F.col(column)), ANSWER_SCHEMA))
    none = F.array().cast("array<string>")
    return parsed.select(
        *answers.columns, F.col("_j.page_purpose").alias("page_purpose"),
        F.coalesce("_j.target_users", none).alias("target_users"), F.col("_j.elements").alias("elements"),
        F.col("_j.steps").alias("steps"), F.coalesce("_j.common_issues", none).alias("common_issues"),
        F.array_compact(F.array(*[F.when(F.col(f"_j.{f}").isNull(), F.lit(f)) for f in ANSWER_REQUIRED])).alias("missing"))
