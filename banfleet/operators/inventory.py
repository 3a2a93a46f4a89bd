"""Agent inventory: keys, versions, effective settings, installs, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from banfleet import __version__
from banfleet.functions import inventory as i
from banfleet.functions.jsontext import encode

# Install steps in the order in which they run.
INSTALL_STEPS = (
    "boot",
    "preflight",
    "distro_detect",
    "panel_detect",
    "api_test",
    "python_check",
    "venv_module",
    "user_create",
    "dirs_create",
    "package_download",
    "venv_setup",
    "config_generate",
    "fail2ban_setup",
    "selinux_setup",
    "systemd_install",
    "service_start",
    "health_check",
    "install_complete",
)
DEFAULT_LOG = "/var/log/fail2ban.log"


def agent_keys(agents: DataFrame) -> DataFrame:
    key = F.col("api_key")
    return agents.select(
        "hostname",
        "agent_id",
        i.key_is_valid(key).alias("key_valid"),
        i.mask_key(key).alias("key_masked"),
    )


def agent_versions(agents: DataFrame) -> DataFrame:
    text = F.col("version_text")
    major, minor = i.version_parts(text)
    return agents.select(
        "hostname",
        "agent_id",
        i.version_number(text).alias("version"),
        major.alias("major"),
        minor.alias("minor"),
        i.version_too_old(text).alias("too_old"),
    )


def effective_value(key: str, value: Column | str = "value") -> Column:
    """Aggregate: the override file goes before the main one, the last line wins."""
    text = F.col(value) if isinstance(value, str) else value

    def last_in(file: str) -> Column:
        match = (F.col("file") == file) & (F.col("key") == key)
        return F.max(F.when(match, F.struct(F.col("line_no"), text.alias("value"))))["value"]

    empty = F.lit("")
    return F.coalesce(F.nullif(last_in("local"), empty), F.nullif(last_in("conf"), empty))


def settings_effective(settings: DataFrame) -> DataFrame:
    """Per host: log target, whether it can be read, and the feed switch."""
    stripped = F.regexp_replace("value", r"[ \t\r\n]", "")
    chosen = settings.groupBy("hostname").agg(
        effective_value("logtarget", stripped).alias("log_target"),
        effective_value("include_global").alias("_include_global"),
    )
    target = F.col("log_target")
    return chosen.select(
        "hostname",
        target,
        i.usable_log_target(target).alias("log_usable"),
        F.when(target.startswith("/"), target)
        .when(i.usable_log_target(target), F.lit(DEFAULT_LOG))
        .alias("log_path"),
        i.text_to_bool(F.col("_include_global"), True).alias("include_global"),
    )


def install_last(events: DataFrame) -> DataFrame:
    """Last install event per host."""
    last = F.max(F.struct("at_s", "seq", "event", "step_name", "error_code")).alias("_last")
    return events.groupBy("hostname").agg(last).select(
        "hostname", "_last.at_s", "_last.event", "_last.step_name", "_last.error_code"
    )


def step_order(step: Column) -> Column:
    """Place of a step in an install, NULL for others."""
    names = F.array(*[F.lit(s) for s in INSTALL_STEPS])
    return F.nullif(F.array_position(names, step), F.lit(0).cast("bigint"))


def install_funnel(events: DataFrame) -> DataFrame:
    """Events and hosts per step, kind of event and error code, in step order.

    Counted per host first: that aggregate combines map-side, and leaves one row
    per host and step for counting hosts.
    """
    group = ["step_name", "event", "error_code"]
    per_host = events.groupBy(*group, "hostname").agg(F.count("*").alias("_n"))
    return (
        per_host.groupBy(*group)
        .agg(F.sum("_n").alias("events"), F.count("*").alias("hosts"))
        .withColumn("step_order", step_order(F.col("step_name")))
    )


def install_event_body(version: str = __version__) -> Column:
    """JSON body of an install or lifecycle event."""
    return encode(
        F.struct(
            "event",
            "step_name",
            "message",
            "error_code",
            "hostname",
            "os_info",
            F.lit(version).alias("agent_version"),
        )
    )


def verify(artifacts: DataFrame, content: str = "content", sidecar: str = "sidecar") -> DataFrame:
    """Compare each artifact's SHA-256 with its checksum file; NULL without one."""
    expected = F.nullif(i.sidecar_digest(F.col(sidecar)), F.lit(""))
    actual = F.sha2(F.col(content), 256)
    return artifacts.withColumns(
        {"expected": expected, "actual": actual, "verified": expected == actual}
    ).drop(content, sidecar)


def verify_files(
    spark: SparkSession,
    path: str,
    suffix: str = ".sha256",
    *,
    glob: str | None = None,
    artifact: Column | None = None,
    is_sidecar: Column | None = None,
) -> DataFrame:
    """The same for files: an artifact and its checksum file lie side by side.

    Every file is read once, and only its digest goes on. By default a checksum file has the path of
    its artifact and ``suffix``; ``artifact`` and ``is_sidecar``, columns of ``path``, say it another way. ``glob``
    picks file names. A checksum file without an artifact gives no row, nor does an empty
    artifact: Spark passes over files of no length.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    is_sidecar = F.col("path").endswith(suffix) if is_sidecar is None else is_sidecar
    bare = F.when(F.col("path").endswith(suffix), F.expr(f"left(path, length(path) - {len(suffix)})")).otherwise(F.col("path"))
    digest = F.when(is_sidecar, i.sidecar_digest(F.decode("content", "UTF-8"))).otherwise(F.sha2("content", 256))
    digests = reader.load(path).select((bare if artifact is None else artifact).alias("path"), is_sidecar.alias("_sidecar"), digest.alias("_digest"))
    found = digests.groupBy("path").agg(
        F.max(F.when(F.col("_sidecar"), F.nullif("_digest", F.lit("")))).alias("expected"),
        F.max(F.when(~F.col("_sidecar"), F.col("_digest"))).alias("actual"),
    )
    return found.where("actual IS NOT NULL").withColumn("verified", F.col("expected") == F.col("actual"))
