"""Run tables: one row per run from text-log patterns and JSON fields
(RUN1-RUN4, SRC9, SRC10, FN1-FN3, FN10, FN11, JOIN5-JOIN7, WIN9).

All per-run extraction is a single grouped aggregation (``min_by`` on the
line / document number = first match in file order) with map-side partial
aggregation, so a run with a third of all lines does not end up in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..config import materialize
from ..functions.scalar import pattern_to_regex, var_from_path

FLOAT, STRING = "float", "string"
NAN = float("nan")
NULL_TEXT = "(NULL)"

# The run-archive path pattern and the per-run log patterns.
TRACE_PATH_PATTERN = ".*BENCH=phoronix/POWER=.*/MONITORING=.*/PHORONIX=.*/.*/.*.tar"
PATH_VARS = ("POWER", "PHORONIX", "MONITORING")
PERF_PATTERNS = [
    (FLOAT, "usr_bin_time", "time.err", "{pattern:F}"),
    (FLOAT, "sysbench_trps", "run.out", "{:s}transactions:{:s}{:d}{:s}({pattern:F} per sec.)"),
]
MAX_RESULTS = 2


def energy_patterns():
    return ([(FLOAT, f"cpu{i}_package_joules", "cpu-energy-meter.out", f"cpu{i}_package_joules={{pattern:F}}")
             for i in range(4)]
            + [(FLOAT, f"cpu{i}_dram_joules", "cpu-energy-meter.out", f"cpu{i}_dram_joules={{pattern:F}}")
               for i in range(4)])


@dataclass(frozen=True)
class RunColumn:
    name: str
    dtype: str  # FLOAT | STRING


def typed(value: Column, dtype: str) -> Column:
    """EXP23: cast with default -- NaN for floats, ``(NULL)`` for strings."""
    return F.coalesce(typed_or_null(value, dtype), F.lit(NAN if dtype == FLOAT else NULL_TEXT))


def typed_or_null(value: Column, dtype: str) -> Column:
    return value.try_cast("double") if dtype == FLOAT else value.cast("string")


def empty_run_table(spark: SparkSession, columns: list) -> DataFrame:
    """RUN2: zero rows with the declared schema."""
    schema = T.StructType([T.StructField(c.name, T.DoubleType() if c.dtype == FLOAT else T.StringType())
                           for c in columns])
    return spark.createDataFrame([], schema)


def run_index(run_lines: DataFrame, run_docs: DataFrame, regexp: str = TRACE_PATH_PATTERN) -> DataFrame:
    """RUN1 index: distinct run paths matching the pattern (anchored at the start)."""
    paths = run_lines.select("path").unionByName(run_docs.select("path")).distinct()
    return paths.where(F.col("path").rlike("^(?:" + regexp + ")"))


def first_pattern_matches(run_lines: DataFrame, patterns: list) -> DataFrame:
    """SRC10 / WIN9: per path, for each (dtype, name, member, pattern), the value
    captured by the first line (lowest line_no) of the member fully matching."""
    aggs = []
    for dtype, name, member, pattern in patterns:
        rx = pattern_to_regex(pattern)
        hit = (F.col("member") == member) & F.col("line").rlike(rx)
        value = F.regexp_extract("line", rx, 1)
        if dtype == FLOAT:  # numbers, so that the aggregate hashes
            value = F.coalesce(value.try_cast("double"), F.lit(NAN))
        aggs.append(F.min_by(F.when(hit, value), F.when(hit, F.col("line_no"))).alias(name))
    return run_lines.groupBy("path").agg(*aggs)


RESULT_SCHEMA = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("test", T.StringType()), T.StructField("arguments", T.StringType()),
    T.StructField("units", T.StringType()),
    T.StructField("results", T.StructType([T.StructField("schedrecord", T.StructType([
        T.StructField("value", T.StringType())]))]))])))])


def result_entries(run_docs: DataFrame, member: str = "phoronix.json") -> DataFrame:
    """FN3 / FN4: one row per ``results`` entry: path, doc_no, pos, test,
    arguments, units, value (text)."""
    return (run_docs.where(F.col("member") == member)
                    .select("path", "doc_no", F.posexplode(F.from_json("doc", RESULT_SCHEMA)["results"])
                            .alias("pos", "r"))
                    .select("path", "doc_no", "pos", F.col("r.test").alias("test"),
                            F.col("r.arguments").alias("arguments"), F.col("r.units").alias("units"),
                            F.col("r.results.schedrecord.value").alias("value")))


def nth_results(run_docs: DataFrame, n: int = MAX_RESULTS, member: str = "phoronix.json") -> DataFrame:
    """The first ``n`` result entries per path (document order) as columns
    ``phoro_{test,args,units,value}{i}``.

    ``row_number() <= n`` lets Spark apply a partial per-task top-n before the
    shuffle (window group limit), so a path with a huge share of the entries
    still ships at most n rows per task."""
    w = Window.partitionBy("path").orderBy("doc_no", "pos")
    top = (result_entries(run_docs, member).withColumn("_tt_rn", F.row_number().over(w))
           .where(F.col("_tt_rn") <= n))
    # at most n entries a path
    rows = top.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("_tt_rn", "test", "arguments", "units", "value"))).alias("r"))
    cols = [F.get("r", F.lit(i))[field].alias(f"phoro_{short}{i}") for i in range(n)
            for field, short in (("test", "test"), ("arguments", "args"), ("units", "units"), ("value", "value"))]
    return rows.select("path", *cols)


def json_field(run_docs: DataFrame, name: str, member: str, json_path: str) -> DataFrame:
    """SRC9: per path, a JSON path of the member's first document."""
    return (run_docs.where(F.col("member") == member)
                    .groupBy("path")
                    .agg(F.min_by(F.get_json_object("doc", json_path), F.col("doc_no")).alias(name)))


def traces_summary(run_lines: DataFrame, run_docs: DataFrame,
                   regexp: str = TRACE_PATH_PATTERN, runs: DataFrame | None = None) -> DataFrame:
    """RUN3: one row per run archive with path variables, performance and
    energy figures, benchmark results, kernel and energy totals.

    ``runs`` (path): the files found; a run without logs then has a row of
    defaults.  Without it the runs are those that left a log."""
    at = F.col("path").rlike("^(?:" + regexp + ")")
    patterns = PERF_PATTERNS + energy_patterns()
    # one pass over the lines, two over the documents; the runs are the groups found
    lines = first_pattern_matches(run_lines.where(at), patterns)
    docs = run_docs.where(at)
    results = nth_results(docs)
    report = F.col("member") == "report.main.json"
    kernel = docs.groupBy("path").agg(F.min_by(F.when(report, F.get_json_object("doc", "$.kernel.version")),
                                               F.when(report, F.col("doc_no"))).alias("kernel"))
    if runs is None:
        t = lines.join(kernel, "path", "full_outer")
    else:
        t = runs.where(at).select("path").distinct().join(lines, "path", "left").join(kernel, "path", "left")
    t = t.join(results, "path", "left")
    cols = [F.col("path").alias("fname")]
    cols += [var_from_path(F.col("path"), v).alias(v) for v in PATH_VARS]
    cols += [typed(F.col(name), dtype).alias(name) for dtype, name, _, _ in patterns]
    for i in range(MAX_RESULTS):
        cols += [typed(F.col(f"phoro_test{i}"), STRING).alias(f"phoro_test{i}"),
                 typed(F.col(f"phoro_args{i}"), STRING).alias(f"phoro_args{i}"),
                 typed(F.col(f"phoro_units{i}"), STRING).alias(f"phoro_units{i}"),
                 typed(F.col(f"phoro_value{i}"), FLOAT).alias(f"phoro_value{i}")]
    cols.append(typed(F.col("kernel"), STRING).alias("kernel"))
    table = t.select(*cols)
    # FN11 / Q26: plain sums, NaN if any part is NaN; later columns read earlier ones
    pk = sum((F.col(f"cpu{i}_package_joules") for i in range(1, 4)), F.col("cpu0_package_joules"))
    dr = sum((F.col(f"cpu{i}_dram_joules") for i in range(1, 4)), F.col("cpu0_dram_joules"))
    table = table.withColumn("total_package_joules", pk).withColumn("total_dram_joules", dr)
    return table.withColumn("total_joules", F.col("total_package_joules") + F.col("total_dram_joules"))


def ratio(a: Column, b: Column) -> Column:
    """FN10 with Q27: a failing cell (division by zero) is NaN."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a / b)


def power_comparison(run_lines: DataFrame, run_docs: DataFrame, kernel: str | None = None,
                     regexp: str = TRACE_PATH_PATTERN) -> DataFrame:
    """RUN4: pair each benchmark's powersave and performance runs of one kernel,
    keep the results present in both and compare their values."""
    index = run_index(run_lines, run_docs, regexp)
    kern = "[^/]+" if kernel is None else kernel.replace(".", r"\.")
    runs = index.select(
        "path", var_from_path(F.col("path"), "PHORONIX").alias("phoronix"),
        F.element_at(F.split("path", "/"), -2).alias("kernel"),
        F.when(F.col("path").rlike(f"^.*BENCH=phoronix/POWER=powersave-y/MONITORING=cpu-energy-meter/PHORONIX=[^/]+/{kern}/1\\.tar$"),
               F.lit("powersave"))
         .when(F.col("path").rlike(f"^.*BENCH=phoronix/POWER=performance-n/MONITORING=cpu-energy-meter/PHORONIX=[^/]+/{kern}/1\\.tar$"),
               F.lit("performance")).alias("mode"))
    # JOIN5: first (sorted) path per benchmark, kernel and mode, full pairs only
    first = runs.where(F.col("mode").isNotNull()).groupBy("phoronix", "kernel").agg(
        F.min(F.when(F.col("mode") == "powersave", F.col("path"))).alias("fpowersave"),
        F.min(F.when(F.col("mode") == "performance", F.col("path"))).alias("fperformance"))
    pairs = first.where("fpowersave is not null and fperformance is not null").select("fpowersave", "fperformance")
    # the documents of paired runs only, parsed once
    paired = pairs.select(F.explode(F.array("fpowersave", "fperformance")).alias("path")).distinct()
    res = materialize(result_entries(run_docs.join(paired, "path", "left_semi"))
                      .select("path", F.struct("doc_no", "pos").alias("o"), "test", "arguments", "units", "value"))
    keys = ["test", "arguments", "units"]
    # JOIN6: powersave results whose key exists in the performance run (duplicates kept)
    left = res.join(pairs.select(F.col("fpowersave").alias("path"), "fperformance"), "path")
    right_keys = res.select(F.col("path").alias("fperformance"), *keys).distinct()
    kept = (left.join(right_keys, ["fperformance"] + keys, "left_semi")
                .withColumnRenamed("path", "fpowersave"))
    # JOIN7: first result with the key in each run -> value
    first_val = res.groupBy("path", *keys).agg(F.min_by("value", "o").alias("v"))
    pv = first_val.select(F.col("path").alias("fpowersave"), *keys, F.col("v").alias("vp"))
    fv = first_val.select(F.col("path").alias("fperformance"), *keys, F.col("v").alias("vf"))
    out = (kept.join(pv, ["fpowersave"] + keys, "left").join(fv, ["fperformance"] + keys, "left")
               .select(*keys,
                       typed(F.col("vp"), FLOAT).alias("perf_value_powersave"),
                       typed(F.col("vf"), FLOAT).alias("perf_value_performance")))
    a, b = F.col("perf_value_powersave"), F.col("perf_value_performance")
    return out.select(*keys, "perf_value_powersave", "perf_value_performance",
                      ratio(a, b).alias("power_perf"), ratio(b, a).alias("perf_power"),
                      ratio(a - b, a).alias("power_perf_power"), ratio(b - a, b).alias("perf_power_perf"))


def _cell(function, dtype: str, default, index: dict, row: dict, name: str, errors: list):
    """One cell: the function's value as its type, or the default if the function or the conversion fails."""
    try:
        value = function(index, row)
        if value is None:
            return default
        return float(value) if dtype == FLOAT else str(value)
    except Exception as e:  # noqa: BLE001 - whatever a user's function raises is that cell's default
        errors.append(f"{name}: {type(e).__name__}: {e}")
        return default


class RunTable:
    """RUN1 / UDF1 / EXP24: a run table declared column by column.

    Columns are added in order and later ones may read earlier ones. ``add_column`` takes a builder
    that maps the table built so far to a Column; ``add_function`` takes a Python function
    ``f(index, row)`` of one row. Failing cells take the column's default (NaN / ``(NULL)``
    unless given), and so do null values; the other cells of the row are not touched.
    """

    def __init__(self, index: DataFrame):
        self.index = index
        self.columns: list = []

    def _add(self, name: str, dtype: str, default, **how) -> "RunTable":
        if dtype not in (FLOAT, STRING):
            raise ValueError(f"{dtype} unsupported")
        if default is None:
            default = NAN if dtype == FLOAT else NULL_TEXT
        self.columns.append({"name": name, "dtype": dtype, "default": default, **how})
        return self

    def add_column(self, name: str, dtype: str, builder, default=None) -> "RunTable":
        return self._add(name, dtype, default, builder=builder)

    def add_function(self, name: str, dtype: str, function, default=None) -> "RunTable":
        """``function(index, row)``: ``index`` has the row's index columns as they were given, ``row`` all
        declared columns; those that are not computed yet hold their defaults."""
        return self._add(name, dtype, default, function=function)

    def columns_name(self) -> list:
        return [c["name"] for c in self.columns]

    def build(self, errors: str | None = None) -> DataFrame:
        """The table. ``errors`` names a further column: messages of the row's failing functions, in order."""
        df = self.index
        taken = {c.lower() for c in df.columns} | {c.lower() for c in self.columns_name()}
        if errors is not None and errors.lower() in taken:
            raise ValueError(f"{errors} is the name of another column")
        index, log = "__index", "__errors"
        df = df.withColumns({index: F.struct(*[F.col(f"`{c}`") for c in df.columns]),
                             log: F.array().cast("array<string>")})
        done = 0
        while done < len(self.columns):
            column = self.columns[done]
            if "builder" in column:
                value = F.coalesce(typed_or_null(column["builder"](df), column["dtype"]), F.lit(column["default"]))
                df = df.withColumn(column["name"], value)
                done += 1
                continue
            run = [c for c in self.columns[done:]]
            run = run[:next((i for i, c in enumerate(run) if "builder" in c), len(run))]
            df = self._apply(df, done, run, index, log)
            done += len(run)
        names = [F.col(f"`{c}`") for c in self.columns_name()]
        return df.select(*names, *([F.col(log).alias(errors)] if errors is not None else []))

    def _apply(self, df: DataFrame, done: int, run: list, index: str, log: str) -> DataFrame:
        """Neighbouring functions in one pass over Arrow batches; every row is seen once."""
        import pyarrow as pa

        new = [c["name"] for c in run]
        low = {c.lower() for c in new}
        keep = [f for f in df.schema.fields if f.name != log and f.name.lower() not in low]
        schema = T.StructType(keep + [T.StructField(c["name"], T.DoubleType() if c["dtype"] == FLOAT else T.StringType()) for c in run]
                              + [T.StructField(log, T.ArrayType(T.StringType()))])
        defaults = {c["name"]: c["default"] for c in self.columns}
        earlier = self.columns_name()[:done]
        source = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(log))
        types = {c["name"]: pa.float64() if c["dtype"] == FLOAT else pa.string() for c in run}

        def compute(batches):
            for batch in batches:
                indexes = batch.column(index).to_pylist()
                before = {c: batch.column(c).to_pylist() for c in earlier}
                logs = [list(messages) for messages in batch.column(log).to_pylist()]
                out = {c: [] for c in new}
                for i, item in enumerate(indexes):
                    row = {**defaults, **{c: values[i] for c, values in before.items()}}
                    for c in run:
                        row[c["name"]] = _cell(c["function"], c["dtype"], c["default"], item, row, c["name"], logs[i])
                        out[c["name"]].append(row[c["name"]])
                arrays = [batch.column(f.name) for f in keep]
                arrays += [pa.array(out[c], types[c]) for c in new] + [pa.array(logs, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

        return source.mapInArrow(compute, schema)
