"""Queries: agent inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet import __version__
from banfleet.operators import inventory as inv
from banfleet.plans import views as v
from banfleet.plans.views import sql
from banfleet.session import scratch_folder


def agent_keys(spark: SparkSession, sf: str) -> DataFrame:
    return inv.agent_keys(v.agents(spark, sf))


def agent_versions(spark: SparkSession, sf: str) -> DataFrame:
    return inv.agent_versions(v.agents(spark, sf))


def settings_effective(spark: SparkSession, sf: str) -> DataFrame:
    return inv.settings_effective(v.settings(spark, sf))


def install_last(spark: SparkSession, sf: str) -> DataFrame:
    return inv.install_last(v.install_events(spark, sf))


def install_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return inv.install_funnel(v.install_events(spark, sf))


def install_event_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Install events as they are sent."""
    events = v.install_events(spark, sf).withColumns(
        {
            "message": F.concat(F.lit('step "'), "step_name", F.lit('" done')),
            "os_info": F.lit("Linux"),
        }
    )
    return events.select("hostname", "seq", inv.install_event_body().alias("body"))


def artifact_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Raw pages as artifacts; some checksum files are wrong or missing."""
    digest = F.sha2(F.encode("html", "UTF-8"), 256)
    wrong = F.reverse(digest)
    sidecar = (
        F.when(F.col("page_id") % 11 == 0, F.lit(None))
        .when(F.col("page_id") % 7 == 0, F.concat(wrong, F.lit("  a.tar\n")))
        .otherwise(F.concat(F.lit("  "), digest, F.lit("  a.tar\nsecond line\n")))
    )
    pages = v.table(spark, sf, "pages").select(
        "page_id", F.encode("html", "UTF-8").alias("content"), sidecar.alias("sidecar")
    )
    return inv.verify(pages)


#: Pages that one artifact file holds.
BUNDLE = 50


def artifact_files(spark: SparkSession, sf: str) -> DataFrame:
    """Pages bundled into files, with checksum files, some wrong or missing; each file is read once."""
    folder = scratch_folder(spark, "artifacts")
    number = F.floor(F.col("page_id") / BUNDLE).cast("bigint")
    pages = v.table(spark, sf, "pages").select(number.alias("artifact"), "page_id", F.coalesce("html", F.lit("")).alias("value"))
    # one file per artifact: its pages, a line each, and the last one ends in a newline too
    dealt = pages.repartition("artifact").sortWithinPartitions("artifact", "page_id")
    dealt.select("artifact", "value").write.partitionBy("artifact").text(f"{folder}/files")
    actual = inv.verify_files(spark, f"{folder}/files/*", artifact=F.regexp_extract("path", "artifact=([0-9]+)/", 1))
    actual = actual.select(F.col("path").cast("bigint").alias("n"), "actual").where("n % 5 <> 0")
    told = F.when(F.col("n") % 3 == 0, F.reverse("actual")).otherwise(F.col("actual"))
    sidecars = actual.select(F.concat(F.col("n").cast("string"), F.lit(".sha256")).alias("artifact"), F.concat(told, F.lit("  pages.txt")).alias("value"))
    sidecars.repartition("artifact").write.mode("append").partitionBy("artifact").text(f"{folder}/files")
    found = inv.verify_files(
        spark, f"{folder}/files/*", glob="part-*",
        artifact=F.regexp_extract("path", "artifact=([0-9]+)", 1), is_sidecar=F.col("path").contains(".sha256/"),
    )
    return found.select(F.col("path").cast("bigint").alias("artifact"), "expected", "actual", "verified")


QUERIES = {
    "agent_keys": agent_keys,
    "agent_versions": agent_versions,
    "settings_effective": settings_effective,
    "install_last": install_last,
    "install_funnel": install_funnel,
    "install_event_bodies": install_event_bodies,
    "artifact_checksums": artifact_checksums,
    "artifact_files": artifact_files,
}

_STEP_ORDER = " ".join(f"WHEN '{s}' THEN {n}" for n, s in enumerate(inv.INSTALL_STEPS, 1))
_EFFECTIVE = """coalesce(
    nullif(arg_max({value}, line_no) FILTER (WHERE file = 'local' AND key = '{key}'), ''),
    nullif(arg_max({value}, line_no) FILTER (WHERE file = 'conf' AND key = '{key}'), ''))"""
_TARGET = _EFFECTIVE.format(value="replace(value, ' ', '')", key="logtarget")
_SWITCH = _EFFECTIVE.format(value="value", key="include_global")

ORACLES = {
    "agent_keys": sql(
        """SELECT hostname, agent_id,
            regexp_matches(api_key, '^ab_(live|test)_[A-Za-z0-9]{16,}$') AS key_valid,
            substr(api_key, 1, 14) || '...' || right(api_key, 4) AS key_masked FROM agents""",
        "agents",
    ),
    "agent_versions": sql(
        """SELECT *, major = 0 AND minor < 10 AS too_old FROM (SELECT hostname, agent_id, version,
            CAST(split_part(version, '.', 1) AS INT) AS major,
            CAST(split_part(version, '.', 2) AS INT) AS minor
          FROM (SELECT *, regexp_extract(version_text, '[0-9]+[.][0-9]+([.][0-9]+)?') AS version
            FROM agents))""",
        "agents",
    ),
    "settings_effective": sql(
        f"""SELECT hostname, log_target,
            log_target IS NULL OR log_target = 'AUTO' OR log_target LIKE '/%' AS log_usable,
            CASE WHEN log_target LIKE '/%' THEN log_target
              WHEN log_target IS NULL OR log_target = 'AUTO' THEN '{inv.DEFAULT_LOG}' END
              AS log_path,
            coalesce(lower(nullif(trim(switch, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '')) IN ('1', 'true', 'yes', 'on'), true)
              AS include_global
          FROM (SELECT hostname, {_TARGET} AS log_target, {_SWITCH} AS switch
            FROM settings GROUP BY hostname)""",
        "settings",
    ),
    "install_last": sql(
        """SELECT hostname, at_s, event, step_name, error_code FROM (SELECT *, row_number() OVER
            (PARTITION BY hostname ORDER BY at_s DESC, seq DESC) AS rn FROM install_events)
          WHERE rn = 1""",
        "install_events",
    ),
    "install_funnel": sql(
        f"""SELECT step_name, event, error_code, count(*) AS events,
            count(DISTINCT hostname) AS hosts,
            CAST(CASE step_name {_STEP_ORDER} END AS BIGINT) AS step_order
          FROM install_events GROUP BY 1, 2, 3""",
        "install_events",
    ),
    "install_event_bodies": sql(
        f"""SELECT hostname, seq, '{{"event":"' || event || '","step_name":"' || step_name ||
            '","message":"step \\"' || step_name || '\\" done","error_code":' ||
            coalesce('"' || error_code || '"', 'null') || ',"hostname":"' || hostname ||
            '","os_info":"Linux","agent_version":"{__version__}"}}' AS body
          FROM install_events""",
        "install_events",
    ),
    "artifact_checksums": """SELECT page_id, sha256(html) AS actual,
        CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN reverse(sha256(html))
          ELSE sha256(html) END AS expected,
        CASE WHEN page_id % 11 = 0 THEN NULL ELSE page_id % 7 <> 0 END AS verified FROM pages""",
    "artifact_files": f"""SELECT artifact, actual, CASE WHEN artifact % 5 = 0 THEN NULL WHEN artifact % 3 = 0 THEN reverse(actual)
        ELSE actual END AS expected, CASE WHEN artifact % 5 = 0 THEN NULL ELSE artifact % 3 <> 0 END AS verified
      FROM (SELECT page_id // {BUNDLE} AS artifact, sha256(string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id)) AS actual
        FROM pages GROUP BY 1)""",
}
