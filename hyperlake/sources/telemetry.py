"""Telemetry lines and traces normalised to one KPM row shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

# fixed values: accepted terminal names per KPM column, first alias wins
KPM_ALIASES = {
    "cqi": ("CQI", "cqi", "wideband_cqi", "wb_cqi"),
    "rsrp_dbm": ("RSRP", "rsrp", "rsrp_dbm"),
    "rsrq_db": ("RSRQ", "rsrq", "rsrq_db"),
    "sinr_db": ("SINR", "sinr", "sinr_db", "snr_db"),
    "dl_throughput_mbps": ("DRB.UEThpDl", "dl_throughput_mbps", "ue_thp_dl"),
    "ul_throughput_mbps": ("DRB.UEThpUl", "ul_throughput_mbps", "ue_thp_ul"),
    "dl_drop_rate": ("DRB.RlcPacketDropRateDl", "dl_drop_rate", "rlc_packet_drop_rate_dl"),
    "ul_success_rate": ("DRB.PacketSuccessRateUlgNBUu", "ul_success_rate", "packet_success_rate_ul"),
    "dl_volume_bytes": ("DRB.RlcSduTransmittedVolumeDL", "dl_volume_bytes", "rlc_sdu_tx_volume_dl"),
    "ul_volume_bytes": ("DRB.RlcSduTransmittedVolumeUL", "ul_volume_bytes", "rlc_sdu_tx_volume_ul"),
}
TIME_ALIASES = ("time_s", "timestamp_s", "sim_time_s", "time", "timestamp")
UE_ALIASES = ("ue_id", "UE_id", "rnti", "ue", "ueId")
CELL_ALIASES = ("cell_id", "cell", "pci", "gnb_id", "nr_cell_id")
# fixed values: accepted column names of trace CSVs
TRACE_ALIASES = {
    "time_s": ("time_s", "Time", "time", "simTime", "timestamp"),
    "ue_id": ("ue_id", "IMSI", "imsi", "RNTI", "rnti", "ueId"),
    "cell_id": ("cell_id", "CellId", "cellId", "cell", "PCI", "pci"),
    "rsrp_dbm": ("rsrp_dbm", "RSRP", "rsrp", "Rsrp"),
    "rsrq_db": ("rsrq_db", "RSRQ", "rsrq", "Rsrq"),
    "sinr_db": ("sinr_db", "SINR", "sinr", "Sinr", "SNR", "snr"),
    "cqi": ("cqi", "CQI", "Cqi"),
    "dl_throughput_mbps": ("dl_throughput_mbps", "throughput_mbps", "ThroughputMbps", "dlThroughputMbps"),
    "ul_throughput_mbps": ("ul_throughput_mbps", "ulThroughputMbps"),
    "dl_drop_rate": ("dl_drop_rate", "drop_rate", "packetDropRate"),
}
COLUMNS = (
    "time_s", "ue_id", "cell_id", "rsrp_dbm", "rsrq_db", "sinr_db", "cqi", "dl_throughput_mbps", "ul_throughput_mbps",
    "dl_drop_rate", "ul_success_rate", "dl_volume_bytes", "ul_volume_bytes", "source",
)
FRACTIONS = ("dl_drop_rate", "ul_success_rate")

_SCALAR = r'("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)'


def numeric_or_null(text: Column) -> Column:
    """Finite number or null; a truth value is 1 or 0."""
    x = F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def percent_to_fraction(x: Column) -> Column:
    return F.when(x > 1, x / 100).otherwise(x)


def _scan_keys(line: Column) -> tuple[Column, Column]:
    """All keys with scalar values at any depth and those values, latest first."""
    pattern = r'"((?:[^"\\]|\\.)*)"\s*:\s*' + _SCALAR
    both = lambda g: F.reverse(F.regexp_extract_all(line, F.lit(pattern), F.lit(g)))
    return both(1), both(2)


def _ranked_keys(line: Column) -> Column:
    """``array<struct<path, at, k, v>>`` of all keys with scalar values, the one that counts first.

    Of equal names the one in a nested container counts before one beside that container, and of several containers the
    last one.  ``path`` holds where the containers around a key open, from the outside in, and a zero: compared as arrays,
    the greater path is the one that counts.
    """
    key = r'"((?:[^"\\]|\\.)*)"\s*:\s*' + _SCALAR
    tokens = F.regexp_extract_all(line, F.lit(f'{key}|"(?:[^"\\\\]|\\\\.)*"|[{{}}\\[\\]]'), F.lit(0))
    none = "array<struct<path: array<int>, at: int, k: string, v: string>>"
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast(none).alias("out"), F.lit(0).alias("at"))

    def step(s: Column, t: Column) -> Column:
        at = s["at"] + 1
        stack = F.when(t.isin("{", "["), F.concat(s["stack"], F.array(at))).when(t.isin("}", "]"), F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))).otherwise(s["stack"])
        entry = F.struct(F.concat(s["stack"], F.array(F.lit(0))).alias("path"), at.alias("at"), F.regexp_extract(t, key, 1).alias("k"), F.regexp_extract(t, key, 2).alias("v"))
        return F.struct(stack.alias("stack"), F.when(t.rlike(f"^{key}$"), F.concat(s["out"], F.array(entry))).otherwise(s["out"]).alias("out"), at.alias("at"))

    return F.reverse(F.array_sort(F.aggregate(tokens, start, step, lambda s: s["out"])))


FIELDS = {**KPM_ALIASES, "time_s": TIME_ALIASES, "ue_id": UE_ALIASES, "cell_id": CELL_ALIASES}


def _positions(keys: Column, names: Sequence[str]) -> Column:
    """Where each known alias stands among the keys (0 when absent): one pass per line."""
    return F.transform(F.array(*[F.lit(a) for a in names]), lambda a: F.array_position(keys, a))


def _lookup(keys: Column, values: Column, positions: Column, dotted: Column, aliases: Sequence[str], names: Sequence[str]) -> Column:
    """Scalar of the first alias present; exact names before dotted suffixes.

    Where a name occurs more than once, keys come in the order of :func:`_ranked_keys`.
    """
    exact = F.coalesce(*[F.nullif(F.get(positions, F.lit(names.index(a))), F.lit(0)) for a in aliases])
    wanted = F.array(*[F.lit(a) for a in aliases])
    tails = F.transform(wanted, lambda a: F.array_position(F.transform(keys, lambda k: F.endswith(k, F.concat(F.lit("."), a))), F.lit(True)))
    suffix = F.get(F.filter(tails, lambda i: i > 0), F.lit(0))
    got = F.get(values, F.coalesce(exact, F.when(dotted, suffix)).cast("int") - 1)
    return F.when(got != "null", F.btrim(got, F.lit('"')))


def _unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\(.)", "$1")).otherwise(text)


def parse_kpm(lines: DataFrame, column: str = "value", throughput_scale: float = 1.0, volume_scale: float = 1.0, default_time_s: float | None = None, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """KPM rows plus ``problem`` (invalid_json / no_time) from JSON lines.

    Blank lines and control envelopes (a ``cmd`` key and at most two keys) are
    skipped.  Rows with a problem keep their text so that a caller can reject them.
    ``aliases`` replaces the accepted names of the columns it mentions.
    """
    text = F.trim(F.col(column))
    df = lines.withColumn("_t", text).filter("_t <> ''")
    keys = F.json_object_keys("_t")
    df = df.filter(~F.coalesce(F.array_contains(keys, "cmd") & (F.size(keys) <= 2), F.lit(False)))
    t = F.col("_t")
    found = _scan_keys(t)
    df = df.withColumns({"_k": found[0], "_v": found[1]})
    # only where a name comes twice does it matter which of its places counts
    df = df.withColumn("_ranked", F.when(F.size("_k") != F.size(F.array_distinct("_k")), _ranked_keys(t)))
    df = df.withColumns({"_k": F.coalesce("_ranked.k", "_k"), "_v": F.coalesce("_ranked.v", "_v")}).drop("_ranked")
    # most lines have no dotted key beyond the aliases, and skip the suffix search
    fields = {**FIELDS, **(aliases or {})}
    names = list(dict.fromkeys(a for al in fields.values() for a in al))
    plain = F.array(*[F.lit(a) for a in names if "." in a]).cast("array<string>")
    df = df.withColumns({"_pos": _positions(F.col("_k"), names), "_dot": F.contains(F.array_join(F.array_except("_k", plain), " "), F.lit("."))})
    look = lambda field: _lookup(F.col("_k"), F.col("_v"), F.col("_pos"), F.col("_dot"), fields[field], names)
    vals = {name: numeric_or_null(look(name)) for name in KPM_ALIASES}
    for name in FRACTIONS:
        vals[name] = percent_to_fraction(vals[name])
    for name in ("dl_throughput_mbps", "ul_throughput_mbps"):
        vals[name] = vals[name] * F.lit(float(throughput_scale))
    for name in ("dl_volume_bytes", "ul_volume_bytes"):
        vals[name] = vals[name] * F.lit(float(volume_scale))
    time = numeric_or_null(look("time_s"))
    if default_time_s is not None:
        time = F.coalesce(time, F.lit(float(default_time_s)))
    vals.update({"time_s": time, "ue_id": _unescape(look("ue_id")), "cell_id": _unescape(look("cell_id")), "source": F.lit("srsran")})
    problem = F.when(F.try_parse_json("_t").isNull(), "invalid_json").when(time.isNull(), "no_time")
    keep = [c for c in lines.columns if c != column]
    return df.select(*keep, *[vals[c].alias(c) for c in COLUMNS], problem.alias("problem"), F.when(problem.isNotNull(), t).alias("rejected_text"))


def read_kpm_jsonl(spark: SparkSession, path: str, **kw) -> DataFrame:
    return parse_kpm(spark.read.text(path), **kw)


_NATIVE = """time_s STRING, timestamp_s STRING, cells ARRAY<STRUCT<pci: STRING, cell_metrics: STRUCT<pci: STRING>, ue_list: ARRAY<STRUCT<
  rnti: STRING, ue: STRING, pci: STRING, cqi: STRING, pusch_snr_db: STRING, pusch_rsrp_db: STRING, dl_brate: STRING, ul_brate: STRING,
  dl_nof_ok: STRING, dl_nof_nok: STRING, ul_nof_ok: STRING, ul_nof_nok: STRING>>>>"""


def parse_native_scheduler(lines: DataFrame, column: str = "value", line_no: str | None = None, start_time_s: float = 0.0, period_s: float | None = None) -> DataFrame:
    """One KPM row per listed UE.

    Without a numeric time the i-th usable line gets ``start + i * period``.  That
    needs an order, so ``line_no`` must name a line-number column whenever
    ``period_s`` is given.
    """
    df = lines.withColumn("_t", F.trim(F.col(column))).filter("_t <> ''")
    keys = F.json_object_keys("_t")
    df = df.filter(~F.coalesce(F.array_contains(keys, "cmd") & (F.size(keys) <= 2), F.lit(False)))
    df = df.withColumn("_j", F.from_json("_t", _NATIVE))
    t = numeric_or_null(F.coalesce(F.col("_j.time_s"), F.col("_j.timestamp_s")))
    keep = [c for c in lines.columns if c != column]
    df = df.select(*keep, t.alias("_time"), F.col("_j.cells").alias("_cells"))
    t = F.col("_time")
    if period_s is not None:
        if line_no is None:
            raise ValueError("period_s needs a line_no column")
        from .. import ordered

        # lines are read and parsed once; what they hold is written, numbered and joined, not their text
        df = cut(df)
        # lines of one number share their index
        numbers = ordered.scan(df.select(line_no).distinct(), [], [line_no], {"_i": ordered.rnumber()})
        df = df.join(numbers, line_no)
        t = F.coalesce(t, F.lit(float(start_time_s)) + (F.col("_i") - 1) * F.lit(float(period_s)))
    df = df.withColumn("time_s", t)
    ue = df.select(*keep, "time_s", F.explode("_cells").alias("c")).select(*keep, "time_s", F.coalesce("c.pci", "c.cell_metrics.pci").alias("_pci"), F.explode("c.ue_list").alias("u"))
    n = lambda f: numeric_or_null(F.col(f"u.{f}"))
    drop = lambda bad, good: F.when(good + bad > 0, bad / (good + bad))
    null = F.lit(None).cast("double")
    return ue.select(
        *keep, "time_s", F.coalesce("u.rnti", "u.ue").alias("ue_id"), F.coalesce("u.pci", "_pci").alias("cell_id"), n("pusch_rsrp_db").alias("rsrp_dbm"), null.alias("rsrq_db"),
        n("pusch_snr_db").alias("sinr_db"), n("cqi").alias("cqi"), (n("dl_brate") / 1000).alias("dl_throughput_mbps"), (n("ul_brate") / 1000).alias("ul_throughput_mbps"),
        drop(n("dl_nof_nok"), n("dl_nof_ok")).alias("dl_drop_rate"), drop(n("ul_nof_ok"), n("ul_nof_nok")).alias("ul_success_rate"),
        null.alias("dl_volume_bytes"), null.alias("ul_volume_bytes"), F.lit("srsran-native").alias("source"),
        F.when(F.col("time_s").isNull(), "no_time").alias("problem"),
    )


def read_native_scheduler_jsonl(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Lines without a time need an order: give them a ``line_no`` column and use parse_native_scheduler."""
    return parse_native_scheduler(spark.read.text(path), **kw)


def parse_trace(rows: DataFrame, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Trace rows by declared column aliases; rows without a time carry a problem."""
    al = {**(aliases or TRACE_ALIASES)}

    def get(name: str) -> Column:
        cols = [F.col(f"`{a}`").cast("string") for a in al.get(name, (name,)) if a in rows.columns]
        return cols[0] if cols else F.lit(None).cast("string")

    out = []
    for c in COLUMNS[:-1]:
        if c in ("ue_id", "cell_id"):
            out.append(get(c).alias(c))
        elif c in ("ul_success_rate", "dl_volume_bytes", "ul_volume_bytes"):
            out.append(F.lit(None).cast("double").alias(c))
        else:
            x = numeric_or_null(get(c))
            out.append((percent_to_fraction(x) if c == "dl_drop_rate" else x).alias(c))
    got = rows.select(*out, F.lit("5g-lena").alias("source"))
    return got.withColumn("problem", F.when(F.col("time_s").isNull(), "no_time"))


def read_trace_csv(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    return parse_trace(spark.read.option("header", True).csv(path), aliases)
