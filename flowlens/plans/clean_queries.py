"""Source, cleaning, audit and profile queries over text rows and labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import columns as C
from ..operators import clean as CL
from ..operators import profile as PR
from ..operators import score as SC
from ..sources import flow_files as FF
from ..sources import sinks as SK
from ..workspace import run_folder
from .views import DIRTY_FEATURES, FEATURES, dirty_lines, labelled_flows, table, with_views

_COLS = ", ".join(f'"{c}"' for c in DIRTY_FEATURES)
BLOCK_BYTES = 4096  # of the fingerprints over blocks


def _num(col: str, to: str = "FLOAT") -> str:
    return f'CASE WHEN isfinite(TRY_CAST("{col}" AS DOUBLE)) THEN TRY_CAST("{col}" AS DOUBLE)::{to} END'


_TYPED = ", ".join(f'{_num(c)} AS "{c}"' for c in DIRTY_FEATURES)
_CTES = {
    "typed": (("dirty_lines",), f"""
        SELECT {_TYPED}, trim(regexp_replace("Label", '[^\\x20-\\x7E]+', '-', 'g')) AS "Label",
          upper(left(split_part(file, '-', 1), 1)) || lower(substr(split_part(file, '-', 1), 2)) AS day, file
        FROM dirty_lines"""),
    "once": (("typed",), f"""
        SELECT {_COLS}, "Label", upper(left(file, 1)) || lower(substr(split_part(file, '-', 1), 2)) AS day, file,
          CAST(CASE WHEN "Label" <> 'BENIGN' THEN 1 ELSE 0 END AS TINYINT) AS is_attack, copies
        FROM (SELECT {_COLS}, "Label", min(file) AS file, count(*) AS copies FROM typed GROUP BY {_COLS}, "Label")"""),
    "clean": (("once",), f"""
        SELECT {_COLS}, "Label",
          CASE WHEN day IN ('Monday','Tuesday','Wednesday','Thursday','Friday') THEN day END AS day, file, is_attack
        FROM once"""),
    # labelled rows with holes, a constant column and a column of missing values only
    "holes": (("labelled_flows",), """
        SELECT sample_id, line_count, qty_sum, CASE WHEN sample_id % 13 <> 0 THEN qty_min::DOUBLE END AS qty_min,
          CASE WHEN sample_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE qty_max::DOUBLE END AS qty_max, price_cents,
          CAST(7 AS INTEGER) AS fixed, NULL::DOUBLE AS absent, CASE WHEN sample_id % 5 = 0 THEN 3::BIGINT END AS half,
          day, CASE WHEN sample_id % 17 = 0 THEN NULL WHEN sample_id % 19 = 0 THEN ' nan ' WHEN sample_id % 23 = 0 THEN '  '
            ELSE Label END AS Label, is_attack
        FROM labelled_flows"""),
}
_MISSING = "(" + ", ".join("'" + t + "'" for t in S.MISSING_TOKENS) + ")"


def _sql(body: str, *views: str) -> str:
    return with_views(body, views, _CTES)


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sid = F.col("sample_id")
    return labelled_flows(spark, sf_dir).select(
        "sample_id", "line_count", "qty_sum",
        F.when(sid % 13 != 0, F.col("qty_min").cast("double")).alias("qty_min"),
        F.when(sid % 11 == 0, F.lit(float("nan"))).otherwise(F.col("qty_max").cast("double")).alias("qty_max"),
        "price_cents",
        F.lit(7).alias("fixed"),
        F.lit(None).cast("double").alias("absent"),
        F.when(sid % 5 == 0, F.lit(3).cast("bigint")).alias("half"),
        "day",
        F.when(sid % 17 == 0, F.lit(None)).when(sid % 19 == 0, " nan ").when(sid % 23 == 0, "  ")
        .otherwise(F.col("Label")).alias("Label"),
        "is_attack",
    )


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.coerce(dirty_lines(spark, sf_dir))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.clean(dirty_lines(spark, sf_dir))


def _written_csv(spark: SparkSession, sf_dir: str) -> str:
    """Latin-1 CSV files of every capture day, with padded headers; Friday's columns are in another
    order with one more, Monday's lack one. A day has a file per task, each in a folder of its own."""
    path = run_folder(spark, "captures")
    rows = dirty_lines(spark, sf_dir)
    files = spark._jvm.org.apache.hadoop.fs
    store = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"):
        name = f"{day}-lines.csv"
        cols = [c for c in rows.columns if c != "file"]
        if day == "friday":
            cols = [*reversed(cols), "Extra"]
        elif day == "monday":
            cols.remove("Bwd URG Flags")
        own = rows.filter(F.col("file") == name).withColumn("Extra", F.lit("7"))
        (
            own.select(*[C.quoted(c).alias(f" {c}") for c in cols])
            .write.option("header", "true").option("encoding", FF.LATIN1)
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{path}-{day}")
        )
        for i, part in enumerate(store.globStatus(files.Path(f"{path}-{day}/part-*"))):
            store.mkdirs(files.Path(f"{path}/{i}"))
            store.rename(part.getPath(), files.Path(f"{path}/{i}/{name}"))
    return path


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of three layouts written and scanned back by their own headers."""
    rows = CL.coerce(FF.read_capture_csv(spark, _written_csv(spark, sf_dir)))
    return rows.groupBy("file", "Label").agg(
        F.count("*").alias("rows"), *[F.sum(C.quoted(c).cast("bigint")).alias(c) for c in DIRTY_FEATURES]
    )


def _segment_files(spark: SparkSession, sf_dir: str) -> str:
    """Text files written from a table, one per market segment."""
    path = run_folder(spark, "segments")
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.concat_ws(" ", "c_name", F.col("c_custkey").cast("string")).alias("line"))
    rows.repartition("c_mktsegment").sortWithinPartitions("c_mktsegment", "c_custkey").select("c_mktsegment", "line").write.partitionBy(
        "c_mktsegment").text(path)
    return path


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the segments' files."""
    return FF.fingerprint(spark, _segment_files(spark, sf_dir), "*.txt").select("length", "sha256")


def large_file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as if they were above the limit of Spark's reader of whole files, and their roots over blocks."""
    path = _segment_files(spark, sf_dir)
    pieces = FF.fingerprint(spark, path, "*.txt", whole_limit=0).select("length", F.lit(None).cast("bigint").alias("blocks"), "sha256")
    return pieces.union(FF.block_fingerprint(spark, path, "*.txt", BLOCK_BYTES).select("length", "blocks", "root"))


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit row per file written and read back: shape, odd cells, duplicates, label counts."""
    path = run_folder(spark, "audit")
    SK.write_audit(PR.audit_report(dirty_lines(spark, sf_dir)), path)
    return spark.read.schema(
        "file string, rows bigint, cols int, inf_cells bigint, nan_cells bigint, duplicate_rows bigint, labels string").json(path)


def clean_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "clean")
    SK.write_clean(clean(spark, sf_dir), path)
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("string")).select(
        *[C.quoted(c) for c in DIRTY_FEATURES], "Label", "day", "file", "is_attack")


def counts_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_folder(spark, "counts")
    SK.write_counts(CL.rows_by_day_label(clean(spark, sf_dir)), path)
    return spark.read.option("header", "true").schema("day string, Label string, `rows` bigint").csv(path)


def csv_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 500 rows of one CSV file in file order, columns typed from their cells."""
    path = run_folder(spark, "head") + ".csv"
    ordered = labelled_flows(spark, sf_dir).select("sample_id", *FEATURES, "Label").orderBy("sample_id")
    ordered.write.option("header", "true").csv(path)
    rows = FF.load_table(spark, path, 500, "Label")
    return rows.select(*[C.quoted(c).cast("bigint").alias(c) for c in ("sample_id", *FEATURES)], "Label")


_RECORD = T.StructType([T.StructField("sample_id", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES[:4]],
                        T.StructField("extra", T.StringType())])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON records parsed and put on a model's columns: one absent, one extra, one text."""
    rows = labelled_flows(spark, sf_dir)
    text = rows.select(F.to_json(F.struct("sample_id", *FEATURES[:4], F.lit("x").alias("extra"))).alias("body"))
    parsed = FF.records_from_json(text, "body", _RECORD)
    return SC.align_to_model(parsed, ["qty_max", "line_count", "Flow Duration", "extra", "qty_sum"], ["sample_id"])


def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PR.column_profile(holes(spark, sf_dir))


_HOLE_COLS = ["sample_id", "line_count", "qty_sum", "qty_min", "qty_max", "price_cents", "fixed", "absent", "half",
              "day", "Label", "is_attack"]


def _profile_sql() -> str:
    parts = []
    for i, c in enumerate(_HOLE_COLS):
        cell = f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN {c} END" if c in ("qty_min", "qty_max", "absent") else c
        distinct = f"count(DISTINCT {cell}) + CASE WHEN count({cell}) < count(*) THEN 1 ELSE 0 END"
        parts.append(
            f"SELECT {i} AS place, '{c}' AS column_name, count(*) - count({cell}) AS missing_cells, {distinct} <= 1 AS is_constant, "
            f"{'false' if c in ('day', 'Label') else 'true'} AS is_numeric, "
            f"{'true' if c in ('Label', 'is_attack') else 'false'} AS label_candidate FROM holes")
    return _sql(" UNION ALL ".join(parts), "holes")


def _missing_sql() -> str:
    cells = [f"count(*) FILTER ({c} IS NULL{f' OR isnan({c})' if c in ('qty_min', 'qty_max', 'absent') else ''})" for c in _HOLE_COLS]
    return _sql(f"SELECT count(*) AS rows, {len(_HOLE_COLS)} AS columns, 10 AS numeric_features, {' + '.join(cells)} AS missing_cells "
                "FROM holes", "holes")


def _audit_sql() -> str:
    names = [*DIRTY_FEATURES, "Label"]
    inner, inf, nan = [], [], []
    for i, c in enumerate(names):
        infinite = f"isinf(TRY_CAST(\"{c}\" AS DOUBLE))"
        inner += [
            f"count(*) FILTER ({infinite}) AS inf{i}",
            f'count(*) FILTER ("{c}" IS NULL OR "{c}" IN {_MISSING}) AS nan{i}',
            f'count(*) FILTER (NOT ("{c}" IS NULL OR "{c}" IN {_MISSING}) AND TRY_CAST("{c}" AS DOUBLE) IS NULL) AS bad{i}',
        ]
        inf.append(f"CASE WHEN bad{i} = 0 THEN inf{i} ELSE 0 END")
        nan.append(f"nan{i}")
    return _sql(f"SELECT file, rows, {len(names)} AS cols, CAST({' + '.join(inf)} AS BIGINT) AS inf_cells, {' + '.join(nan)} AS nan_cells "
                f"FROM (SELECT file, count(*) AS rows, {', '.join(inner)} FROM dirty_lines GROUP BY file)", "dirty_lines")


_PARSED = ", ".join(
    f'CASE WHEN "{c}" IS NOT NULL AND "{c}" NOT IN {_MISSING} THEN coalesce(CAST(TRY_CAST("{c}" AS DOUBLE) AS VARCHAR), "{c}") END AS x{i}'
    for i, c in enumerate([*DIRTY_FEATURES, "Label"]))


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model features by type and name, and the number of classes of the detected label."""
    rows = holes(spark, sf_dir)
    label = S.detect_label(rows.columns)
    features = S.numeric_features(rows.schema, label)
    kept = rows.filter(C.valid_label(C.quoted(label)))
    return kept.agg(
        F.lit(label).alias("label_column"), F.lit(",".join(features)).alias("features"),
        F.lit(len(features)).alias("n_features"),
        F.count_distinct(F.trim(C.quoted(label))).alias("classes"), F.count("*").alias("rows"))


Q: dict[str, tuple] = {
    "s1_s2_csv_scan": (csv_scan, _sql(f"""
        SELECT file, "Label", count(*) AS rows, {", ".join(
          f'''CAST(sum(CAST(CASE WHEN "{c}" IS NOT NULL AND NOT ('{c}' = 'Bwd URG Flags' AND file = 'monday-lines.csv') THEN "{c}" END AS BIGINT)) AS BIGINT) AS "{c}"'''
          for c in DIRTY_FEATURES)}
        FROM typed GROUP BY file, "Label" """, "typed")),
    "s3_s5_csv_head": (csv_head, _sql(f"SELECT sample_id, {', '.join(FEATURES)}, Label FROM labelled_flows ORDER BY sample_id LIMIT 500",
                                   "labelled_flows")),
    "s6_clean_sink": (clean_sink, _sql(f'SELECT {_COLS}, "Label", day, file, is_attack FROM clean', "clean")),
    "s7_counts_sink": (counts_sink, _sql('SELECT day, "Label", count(*) AS rows FROM clean WHERE day IS NOT NULL GROUP BY day, "Label"', "clean")),
    "s9_fingerprint": (fingerprints, """
        SELECT CAST(strlen(body) AS BIGINT) AS length, sha256(body) AS sha256 FROM (
          SELECT string_agg(c_name || ' ' || c_custkey, chr(10) ORDER BY c_custkey) || chr(10) AS body FROM customer GROUP BY c_mktsegment)"""),
    "s9_large_files": (large_file_fingerprints, f"""
        WITH files AS (
          SELECT string_agg(c_name || ' ' || c_custkey, chr(10) ORDER BY c_custkey) || chr(10) AS body FROM customer GROUP BY c_mktsegment),
        digests AS (
          SELECT body, [sha256(substr(body, i * {BLOCK_BYTES} + 1, {BLOCK_BYTES}))
            FOR i IN range(0, (strlen(body) + {BLOCK_BYTES - 1}) // {BLOCK_BYTES})] AS list FROM files)
        SELECT CAST(strlen(body) AS BIGINT) AS length, CAST(NULL AS BIGINT) AS blocks, sha256(body) AS sha256 FROM files
        UNION ALL SELECT CAST(strlen(body) AS BIGINT), CAST(len(list) AS BIGINT), sha256(unhex(array_to_string(list, ''))) FROM digests"""),
    "s10_p11_records": (records, _sql("""
        SELECT sample_id, qty_max::DOUBLE AS qty_max, line_count::DOUBLE AS line_count, NULL::DOUBLE AS "Flow Duration",
          NULL::DOUBLE AS extra, qty_sum::DOUBLE AS qty_sum FROM labelled_flows""", "labelled_flows")),
    "p1_p2_numeric_coercion": (
        lambda s, d: typed(s, d).select(*[C.quoted(c) for c in DIRTY_FEATURES], "file"),
        _sql(f"SELECT {_COLS}, file FROM typed", "typed")),
    "p3_label_text": (
        lambda s, d: typed(s, d).groupBy("Label").agg(F.count("*").alias("rows")),
        _sql('SELECT "Label", count(*) AS rows FROM typed GROUP BY "Label"', "typed")),
    "p4_provenance": (
        lambda s, d: typed(s, d).groupBy("file", "day").agg(F.count("*").alias("rows")),
        _sql("SELECT file, day, count(*) AS rows FROM typed GROUP BY file, day", "typed")),
    "p5_concat_by_name": (
        lambda s, d: FF.concat_by_name([
            typed(s, d).filter("day = 'Monday'").select("Label", "day"),
            typed(s, d).filter("day <> 'Monday'").select("day", "Label", C.quoted("Total Fwd Packets").alias("packets")),
        ]).groupBy("day", "Label").agg(F.count("*").alias("rows"), F.count("packets").alias("packet_cells")),
        _sql("""SELECT day, "Label", count(*) AS rows, count(CASE WHEN day <> 'Monday' THEN "Total Fwd Packets" END) AS packet_cells
          FROM typed GROUP BY day, "Label" """, "typed")),
    "p6_deduplicate": (
        lambda s, d: CL.deduplicate(typed(s, d)),
        _sql(f'SELECT {_COLS}, "Label", day, file, is_attack, copies FROM once', "once")),
    "p7_p8_flag_and_day_order": (
        lambda s, d: clean(s, d).withColumn("day_rank", C.day_rank(F.col("day"))).groupBy("day", "day_rank", "is_attack")
        .agg(F.count("*").alias("rows")),
        _sql("""SELECT day, CAST(CASE day WHEN 'Monday' THEN 1 WHEN 'Tuesday' THEN 2 WHEN 'Wednesday' THEN 3 WHEN 'Thursday' THEN 4
          WHEN 'Friday' THEN 5 END AS INTEGER) AS day_rank, is_attack, count(*) AS rows FROM clean GROUP BY ALL""", "clean")),
    "p9_valid_labels": (
        lambda s, d: holes(s, d).filter(C.valid_label(F.col("Label"))).select("sample_id", F.trim("Label").alias("Label")),
        _sql("""SELECT sample_id, trim(Label) AS Label FROM holes
          WHERE Label IS NOT NULL AND trim(Label) <> '' AND lower(trim(Label)) <> 'nan'""", "holes")),
    "p10_p12_feature_selection": (selection, _sql("""
        SELECT 'Label' AS label_column, 'sample_id,line_count,qty_sum,qty_min,qty_max,price_cents,fixed,absent,half' AS features,
          9 AS n_features, count(DISTINCT trim(Label)) AS classes, count(*) AS rows FROM holes
        WHERE Label IS NOT NULL AND trim(Label) <> '' AND lower(trim(Label)) <> 'nan'""", "holes")),
    "p13_is_benign": (
        lambda s, d: labelled_flows(s, d).select(
            "sample_id", C.is_benign(F.lower("Label")).alias("benign_text"),
            C.is_benign(F.col("is_attack"), "is_attack").alias("benign_flag"),
            C.is_benign(F.col("is_attack"), "Label").alias("flag_under_text_label")),
        _sql("""SELECT sample_id, upper(Label) = 'BENIGN' AS benign_text, is_attack = 0 AS benign_flag,
          false AS flag_under_text_label FROM labelled_flows""", "labelled_flows")),
    "p14_json_rows": (
        lambda s, d: labelled_flows(s, d).select("sample_id", F.to_json(F.struct("sample_id", *FEATURES, "Label")).alias("body")),
        _sql(f"""SELECT sample_id, CAST(json_object('sample_id', sample_id, {", ".join(f"'{f}', {f}" for f in FEATURES)},
          'Label', Label) AS VARCHAR) AS body FROM labelled_flows""", "labelled_flows")),
    "p15_null_filled": (
        lambda s, d: SC.null_filled(holes(s, d), ["qty_min", "qty_max", "absent", "half"], ["sample_id"]),
        _sql("""SELECT sample_id, coalesce(qty_min, 0.0::DOUBLE) AS qty_min, CASE WHEN isnan(qty_max) THEN 0.0::DOUBLE ELSE qty_max END
          AS qty_max, 0.0::DOUBLE AS absent, coalesce(half, 0)::DOUBLE AS half FROM holes""", "holes")),
    "a1_audit": (lambda s, d: PR.audit(dirty_lines(s, d)), _audit_sql()),
    "a2_duplicate_rows": (lambda s, d: PR.duplicate_rows(dirty_lines(s, d)), _sql(
        f"SELECT file, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT file, count(*) AS n FROM (SELECT file, {_PARSED} "
        "FROM dirty_lines) GROUP BY file, x0, x1, x2, x3, x4, x5) GROUP BY file", "dirty_lines")),
    "a3_label_histogram": (lambda s, d: PR.label_histogram(dirty_lines(s, d)), _sql(
        'SELECT file, "Label", count(*) AS rows FROM dirty_lines WHERE "Label" IS NOT NULL GROUP BY file, "Label"', "dirty_lines")),
    "a3_audit_report": (audit_report, f"""
        WITH shape AS ({_audit_sql()}), copies AS (""" + _sql(
        f"SELECT file, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT file, count(*) AS n FROM (SELECT file, {_PARSED} "
        "FROM dirty_lines) GROUP BY file, x0, x1, x2, x3, x4, x5) GROUP BY file", "dirty_lines") + """), names AS (""" + _sql("""
        SELECT file, '{' || string_agg('"' || "Label" || '":' || n, ',' ORDER BY "Label") || '}' AS labels
        FROM (SELECT file, "Label", count(*) AS n FROM dirty_lines WHERE "Label" IS NOT NULL GROUP BY file, "Label") GROUP BY file""", "dirty_lines") + """)
        SELECT * FROM shape JOIN copies USING (file) LEFT JOIN names USING (file)"""),
    "a4_table_profile": (lambda s, d: PR.table_profile(holes(s, d)), _missing_sql()),
    "a5_p12_column_profile": (profile_columns, _profile_sql()),
    "a6_class_counts": (lambda s, d: PR.class_count_report(holes(s, d)), _sql("""
        SELECT * FROM (SELECT 'Label' AS label_column, Label AS value, count(*) AS rows FROM holes GROUP BY Label ORDER BY rows DESC, value NULLS LAST LIMIT 20)
        UNION ALL SELECT * FROM (SELECT 'is_attack', CAST(is_attack AS VARCHAR) AS value, count(*) AS rows FROM holes GROUP BY is_attack
          ORDER BY rows DESC LIMIT 20)""", "holes")),
    "a7_rows_by_day_label": (lambda s, d: CL.rows_by_day_label(clean(s, d)), _sql(
        'SELECT day, "Label", count(*) AS rows FROM clean WHERE day IS NOT NULL GROUP BY day, "Label"', "clean")),
    "a8_a10_reconciliation": (
        lambda s, d: CL.reconciliation(CL.deduplicate(typed(s, d)), DIRTY_FEATURES),
        _sql("""SELECT CAST(sum(copies) AS BIGINT) AS rows_before, count(*) AS rows_after,
          CAST(sum(copies) AS BIGINT) - count(*) AS rows_removed, 5 AS feature_columns FROM once""", "once")),
    "a9_conflicts": (lambda s, d: CL.conflicts(typed(s, d), DIRTY_FEATURES), _sql(
        f"SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS conflicting_rows FROM (SELECT count(*) AS n FROM clean GROUP BY {_COLS}) WHERE n > 1",
        "clean")),
}
