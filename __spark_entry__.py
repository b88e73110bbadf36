"""

The given tables are clean, so each query first derives messy input from them by
a deterministic expression over all rows; the oracle states the clean result
independently wherever it can. File queries write a given table with one of the
sinks into the scratch folder and read it back with the matching source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tablecare as tc
from tablecare.functions.text import iso_seconds
from tablecare.session import configure, scratch_path
from tablecare.sources.charset import charset_census, paths_by_charset
from tablecare.sources.workbook import read_workbooks
from tablecare.streaming.latest import keep_last, read_last
from tablecare.streaming.recipes import compact_stream_run, read_stream_run, run_stream
from tablecare.streaming.tables import dedup_first, read_stream, write_stream

try:
    import corpus_pipeline
    from tablecare.llm import queries as llm
except ImportError:
    # the training-data subpackage is optional
    _LLM_QUERIES, _LLM_ORACLES = {}, {}
else:
    _LLM_QUERIES = llm.queries() | {"pipeline": corpus_pipeline.run}
    _LLM_ORACLES = llm.oracle_sql()
    if corpus_pipeline.ORACLE_SQL:
        _LLM_ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

SMOKE_DIR = "/root/testdata/sf0.001"

FLAGSHIP_RECIPE = """
# columns: o_orderkey, full_name, signed_up
trim_collapse(columns=["full_name"])
date_normalize(column="signed_up")
split_column(column="full_name", delimiter="")
rename_single(column="full_name_1", new_name="kind")
rename_single(column="full_name_2", new_name="code")
"""

PART_RECIPE = """
trim_collapse(columns=["p_name"])
split_column(column="p_name", delimiter=" ", width=2)
combine_columns(columns=["p_brand", "p_size"], new_name="label", separator="-")
remove_columns(columns=["p_type", "p_retailprice"])
rename_single(column="p_name_1", new_name="first")
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- messy input, derived from the given tables -------------------------------


def _messy_date() -> Column:
    """Eight spellings of an order date, by the order key."""
    day = F.col("o_orderdate")
    month_day = F.regexp_replace(F.date_format(day, "MMM d yyyy"), "Sep", "Sept")
    spellings = [
        F.date_format(day, "yyyy-MM-dd"),
        F.date_format(day, "MMM d, yyyy"),
        F.date_format(day, "MMMM d, yyyy"),
        F.date_format(day, "yyyy/MM/dd"),
        F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".673918")),
        month_day,
        F.lit("garbage"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T23:30:00-02:00")),
    ]
    form = F.col("o_orderkey") % 8
    chosen = F.when(form == 0, spellings[0])
    for i, spelling in enumerate(spellings[1:], start=1):
        chosen = chosen.when(form == i, spelling)
    return chosen


def _messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", _messy_date().alias("d"))


def _messy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    gap = (
        F.when(F.col("p_partkey") % 3 == 0, F.lit("\t"))
        .when(F.col("p_partkey") % 3 == 1, F.lit(" \n "))
        .otherwise(F.lit("     "))
    )
    messy = F.concat(
        F.lit(" \t"), F.replace(F.col("p_name"), F.lit(" "), gap), F.lit("  ")
    )
    return part.withColumn("p_name", messy)


def _signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = _table(spark, sf_dir, "orders")
    name = F.concat(
        F.lit("  "),
        F.replace(F.col("c_name"), F.lit("#"), F.lit("   \t")),
        F.lit(" "),
    )
    # which side is broadcast, if any, is left to Spark and its size estimates
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        name.alias("full_name"),
        F.date_format("o_orderdate", "MMM d, yyyy").alias("signed_up"),
    )


# --- transforms ----------------------------------------------------------------


def q_date_normalize(spark, sf_dir):
    return tc.date_normalize(_messy_orders(spark, sf_dir), "d")


def q_date_only(spark, sf_dir):
    return tc.date_only(_messy_orders(spark, sf_dir), "d")


def q_date_day_first(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    written = F.date_format("o_orderdate", "d.M.yyyy")
    messy = orders.select("o_orderkey", written.alias("d"))
    return tc.date_only(messy, "d", day_first=True)


def q_date_half_day(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    written = F.date_format("ts", "EEEE, MMMM d, yyyy h:mm:ss a")
    return tc.date_normalize(events.select("event_id", written.alias("d")), "d")


def q_trim_collapse(spark, sf_dir):
    parts = _messy_parts(spark, sf_dir).select("p_partkey", "p_name")
    return tc.trim_collapse(parts, ["p_name"])


def q_trim_documents(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tc.trim_collapse(documents, ["text"])


def q_combine(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))
    rows = customer.select("c_custkey", "c_name", segment.alias("seg"))
    return tc.combine_columns(rows, ["c_custkey", "c_name", "seg"], "label", "-")


def q_combine_double(spark, sf_dir):
    # prices times a thousand go beyond ten million, where Spark's own cast
    # would turn to exponents
    orders = _table(spark, sf_dir, "orders")
    rows = orders.select(
        "o_orderkey", "o_totalprice", (F.col("o_totalprice") * 1000).alias("mills")
    )
    return tc.combine_columns(rows, ["o_totalprice", "mills"], "label", "|")


def q_split_whitespace(spark, sf_dir):
    parts = _messy_parts(spark, sf_dir).select("p_partkey", "p_name")
    return tc.split_column(parts, "p_name", "")


def q_split_exact(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return tc.split_column(pages, "url", "/")


def q_remove(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer")
    return tc.remove_columns(customer, ["c_acctbal", "c_nationkey"])


def q_rename(spark, sf_dir):
    return tc.rename_single(_table(spark, sf_dir, "customer"), "c_name", "name")


def q_dedup_first(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return tc.dedup_rows(events, ["user_id", "event_type"], "first", ["event_id"])


def q_dedup_last(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return tc.dedup_rows(events, ["user_id", "event_type"], "last", ["event_id"])


def q_dedup_all(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return tc.dedup_rows(orders.select("o_orderstatus", "o_orderpriority"))


def q_dedup_file_order(spark, sf_dir):
    """Keep-first by position in the file, which follows the event id."""
    configure(spark)
    events = tc.read_table(spark, f"{sf_dir}/events.parquet", row_order=True)
    return tc.dedup_rows(events, ["user_id"], "first").drop(tc.ROW_ORDER)


def q_dedup_documents(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return tc.dedup_rows(documents, ["text"], "first", ["doc_id"])


# --- analysis -----------------------------------------------------------------


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    day = F.when(key % 10 == 0, F.lit("garbage")).when(
        key % 3 != 0, F.date_format("o_orderdate", "yyyy/MM/dd")
    )
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 4 != 0, F.col("o_orderpriority")).alias("priority"),
        day.alias("day"),
        "o_totalprice",
        "o_orderdate",
    )


def q_profile(spark, sf_dir):
    return tc.profile(_profiled(spark, sf_dir))


def q_profile_sampled(spark, sf_dir):
    return tc.profile(
        _profiled(spark, sf_dir), date_sample=200, order_by=["o_orderkey"]
    )


def q_preview(spark, sf_dir):
    return tc.preview(_table(spark, sf_dir, "orders"), ["o_orderkey"])


# --- sinks and sources ----------------------------------------------------------


def q_text_datetime(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", iso_seconds(F.col("o_orderdate")).alias("d"))


def _through(spark: SparkSession, df: DataFrame, suffix: str, **options) -> DataFrame:
    """Write with the sink of a format, read back with its source."""
    path = f"{scratch_path(spark, 'round-trip')}.{suffix}"
    tc.write_table(df, path, encoding=options.get("encoding"))
    return tc.read_table(spark, path, **options)


def q_csv(spark, sf_dir):
    return _through(spark, _table(spark, sf_dir, "orders"), "csv")


def q_csv_quoted(spark, sf_dir):
    """Whole documents with quotes, separators and line breaks inside."""
    documents = _table(spark, sf_dir, "documents")
    return _through(spark, documents, "csv")


def q_tsv(spark, sf_dir):
    return _through(spark, _table(spark, sf_dir, "events"), "tsv")


def q_json_lines(spark, sf_dir):
    return _through(spark, _table(spark, sf_dir, "orders"), "jsonl")


def q_parquet(spark, sf_dir):
    return _through(spark, _table(spark, sf_dir, "orders"), "parquet")


def q_workbook(spark, sf_dir):
    path = f"{scratch_path(spark, 'books')}.xlsx"
    tc.write_table(_table(spark, sf_dir, "orders"), path)
    return read_workbooks(spark, path)


def q_late_text(spark, sf_dir):
    """One value past the typing window is no number: all columns become text."""
    lineitem = _table(spark, sf_dir, "lineitem")
    last = F.col("l_orderkey") == lineitem.agg(F.max("l_orderkey")).first()[0]
    # sorted, so that the last order is at the end of the last file
    rows = lineitem.orderBy("l_orderkey").select(
        F.when(last, F.lit("late")).otherwise(F.col("l_orderkey").cast("string")).alias(
            "l_orderkey"
        ),
        "l_linenumber",
        "l_quantity",
    )
    path = f"{scratch_path(spark, 'late')}.csv"
    tc.write_table(rows, path)
    # a window that even the smallest of the given tables exceeds
    return tc.read_table(spark, path, typing_rows=1000)


_TO_MALTESE = ("gCh", "ġĊħ")


def _maltese(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _table(spark, sf_dir, "customer")
    name = F.translate("c_name", *_TO_MALTESE)
    return customer.select("c_custkey", name.alias("c_name"))


def q_charset(spark, sf_dir):
    return _through(
        spark, _maltese(spark, sf_dir), "csv", encoding="ISO-8859-3"
    )


def q_json_charset(spark, sf_dir):
    """Keys of a legacy charset, whose order the records keep."""
    customers = _maltese(spark, sf_dir).withColumnsRenamed({"c_name": "ħz", "c_custkey": "ġb"})
    read = _through(
        spark, customers.select("ħz", "ġb", F.lit(1).alias("a")), "jsonl", encoding="ISO-8859-3"
    )
    return read.withColumn("order_read", F.lit(",".join(read.columns)))


def _mixed_charsets(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_path(spark, "charsets")
    customers = _maltese(spark, sf_dir)
    odd = F.col("c_custkey") % 2 == 1
    tc.write_table(customers.where(odd), f"{folder}/latin.csv", encoding="ISO-8859-3")
    tc.write_table(customers.where(~odd), f"{folder}/utf.csv")
    return f"{folder}/*.csv"


def q_charset_mixed(spark, sf_dir):
    path = _mixed_charsets(spark, sf_dir)
    census = charset_census(spark, path, ["ISO-8859-3"])
    return tc.read_table(spark, path, charsets=paths_by_charset(census))


def q_charset_census(spark, sf_dir):
    path = _mixed_charsets(spark, sf_dir)
    census = charset_census(spark, path, ["US-ASCII", "ISO-8859-3", "ISO-8859-1"])
    possible = F.concat_ws(",", "possible").alias("possible")
    return census.select("utf8", possible, "charset", "ambiguous").distinct()


def q_charset_census_files(spark, sf_dir):
    """One verdict per file: the customers of each market segment are a file."""
    folder = scratch_path(spark, "offices")
    customers = _maltese(spark, sf_dir).join(
        _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey"
    )
    segments = [r[0] for r in customers.select("c_mktsegment").distinct().collect()]
    for segment in segments:
        encoding = "ISO-8859-3" if len(segment) % 2 else None
        rows = customers.where(F.col("c_mktsegment") == segment)
        tc.write_table(rows, f"{folder}/{segment}.csv", single_file=True, encoding=encoding)
    census = charset_census(spark, f"{folder}/*.csv", ["US-ASCII", "ISO-8859-3", "ISO-8859-1"])
    return census.select(
        F.regexp_extract("path", r"([^/]+)\.csv/[^/]+$", 1).alias("segment"),
        "utf8",
        F.concat_ws(",", "possible").alias("possible"),
        "charset",
        "ambiguous",
        "undecodable",
    )


def q_csv_one_column(spark, sf_dir):
    """One column with nulls, which are blank lines."""
    customer = _table(spark, sf_dir, "customer")
    value = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    value = F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(value)
    return _through(spark, customer.select(value.alias("note")), "csv")


def q_csv_splits(spark, sf_dir):
    """Whole documents as CSV in splits far smaller than a file: records go over them."""
    path = f"{scratch_path(spark, 'splits')}.csv"
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # as many files as the table has partitions, so that no task holds it whole
    tc.write_table(documents, path)
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {s: spark.conf.get(s) for s in settings}
    try:
        for setting in settings:
            spark.conf.set(setting, "256k")
        # splits are fixed when the table is read
        rows = tc.read_table(spark, path)
        found = f"{scratch_path(spark, 'splits')}.parquet"
        tc.write_table(rows, found)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
    return tc.read_table(spark, found)


# --- recipes ------------------------------------------------------------------


def q_recipe_refused(spark, sf_dir):
    """A recipe whose last step does not fit leaves the destination as it was."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    source, destination = (f"{scratch_path(spark, 'refused')}.parquet" for _ in range(2))
    tc.write_table(_table(spark, sf_dir, "orders"), source)
    tc.write_table(orders, destination)
    recipe = '''remove_columns(columns=["o_custkey"])
trim_collapse(columns=["o_custkey"])'''
    try:
        tc.run_recipe(spark, recipe, source, destination)
    except ValueError as refused:
        rows = tc.read_table(spark, destination)
        return rows.withColumn("refused", F.lit(str(refused)).contains("step 2"))
    raise AssertionError("the recipe was not refused")


def q_recipe(spark, sf_dir):
    return tc.clean(_signups(spark, sf_dir), FLAGSHIP_RECIPE)


def q_recipe_prefix(spark, sf_dir):
    return tc.apply_recipe(_signups(spark, sf_dir), FLAGSHIP_RECIPE, upto=2).df


def q_recipe_files(spark, sf_dir):
    """A recipe from files to files, read back."""
    source = f"{scratch_path(spark, 'signups')}.csv"
    tc.write_table(_signups(spark, sf_dir), source)
    report = tc.run_recipe(spark, FLAGSHIP_RECIPE, source)
    return tc.read_table(spark, report.destination)


def q_lineage(spark, sf_dir):
    """The record two runs leave: row counts and nulls per touched column."""
    source = f"{scratch_path(spark, 'messy')}.parquet"
    tc.write_table(_messy_orders(spark, sf_dir), source)
    lineage = scratch_path(spark, "lineage")
    for recipe in ('date_only(column="d")', 'dedup_rows(columns=["d"], keep="last")'):
        tc.run_recipe(spark, recipe, source, lineage=lineage)
    rows = spark.read.parquet(lineage)
    return rows.select("rows_in", "rows_out", F.col("null_counts")["d"].alias("nulls"))


# --- streams ------------------------------------------------------------------


def _finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = _table(spark, sf_dir, name).schema
    return read_stream(spark, sf_dir, "parquet", schema, glob=f"{name}.parquet")


def q_stream_recipe(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    cleaned = tc.apply_recipe(_stream(spark, sf_dir, "part"), PART_RECIPE).df
    _finish(write_stream(cleaned, out, "parquet", checkpoint))
    return spark.read.parquet(out)


def q_stream_keep_first(spark, sf_dir):
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    events = _stream(spark, sf_dir, "events")
    first = dedup_first(events, ["user_id", "event_type"], "ts", "3650 days")
    _finish(write_stream(first.select("user_id", "event_type"), out, "parquet", checkpoint))
    return spark.read.parquet(out)


def q_stream_keep_last(spark, sf_dir):
    log, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "progress")
    events = _stream(spark, sf_dir, "events")
    keys, order = ["user_id", "event_type"], ["event_id"]
    _finish(keep_last(events, keys, order, log, checkpoint))
    return read_last(spark, log, keys, order)


_STREAM_RECIPE = """
    rename_single(column="event_type", new_name="kind")
    dedup_rows(columns=["user_id", "kind"], keep="last", order_by=["ts", "event_id"])
    remove_columns(columns=["props"])
    combine_columns(columns=["kind", "user_id"], new_name="label", separator=":")
"""


def q_stream_run(spark, sf_dir):
    """A recipe with a deduplication over several micro-batches, with a base in between."""
    source, log, checkpoint = (scratch_path(spark, n) for n in ("events", "log", "progress"))
    events = _table(spark, sf_dir, "events")
    for part in range(2):
        rows = events.where(F.pmod(F.xxhash64("event_id"), 2) == part)
        rows.repartition(2).write.mode("append").parquet(source)
        stream = read_stream(spark, source, "parquet", events.schema, max_files_per_trigger=1)
        _finish(run_stream(stream, _STREAM_RECIPE, log, checkpoint))
        if not part:
            compact_stream_run(spark, log, _STREAM_RECIPE)
    return read_stream_run(spark, log, _STREAM_RECIPE)


_QUERIES = [
    q_date_normalize,
    q_date_only,
    q_date_day_first,
    q_date_half_day,
    q_trim_collapse,
    q_trim_documents,
    q_combine,
    q_combine_double,
    q_split_whitespace,
    q_split_exact,
    q_remove,
    q_rename,
    q_dedup_first,
    q_dedup_last,
    q_dedup_all,
    q_dedup_file_order,
    q_dedup_documents,
    q_profile,
    q_profile_sampled,
    q_preview,
    q_text_datetime,
    q_csv,
    q_csv_quoted,
    q_tsv,
    q_json_lines,
    q_parquet,
    q_workbook,
    q_late_text,
    q_charset,
    q_charset_mixed,
    q_json_charset,
    q_charset_census,
    q_charset_census_files,
    q_csv_one_column,
    q_csv_splits,
    q_recipe_refused,
    q_recipe,
    q_recipe_prefix,
    q_recipe_files,
    q_lineage,
    q_stream_recipe,
    q_stream_keep_first,
    q_stream_keep_last,
    q_stream_run,
]


def entry(spark: SparkSession) -> DataFrame:
    """The flagship recipe on the smallest tables."""
    return q_recipe(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES} | _LLM_QUERIES


# --- the same results in DuckDB -------------------------------------------------

_CLEAN_DATE = """case o_orderkey % 8
    when 6 then null
    when 4 then date_trunc('second', o_orderdate) + interval 673 millisecond
    when 7 then date_trunc('day', o_orderdate) + interval '25 hours 30 minutes'
    else date_trunc('day', o_orderdate) end"""

_MESSY_PART = r"""' ' || chr(9) || replace(p_name, ' ',
    case p_partkey % 3 when 0 then chr(9) when 1 then ' ' || chr(10) || ' '
    else '     ' end) || '  '"""

_SIGNUPS = """select o_orderkey, date_trunc('day', o_orderdate) as signed_up, c_name
    from customer join orders on c_custkey = o_custkey"""

_ORDERS_AS_TEXT = """select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as o_orderdate, o_orderpriority
    from orders"""

_PROFILE = """
with messy as (
    select *,
        case when o_orderkey % 4 = 0 then null else o_orderpriority end as priority,
        case when o_orderkey % 10 = 0 then 'garbage' when o_orderkey % 3 = 0 then null
            else strftime(o_orderdate, '%Y/%m/%d') end as day
    from orders),
judged as (
    select day from messy where day is not null {sample})
select 'o_orderkey' as column_name, 'int' as type_class,
    count(*) filter (o_orderkey is null) as null_count, false as date_candidate from messy
union all select 'priority', 'str', count(*) filter (priority is null), false from messy
union all select 'day', 'str', (select count(*) from messy where day is null),
    count(*) >= 3 and count(*) filter (day <> 'garbage') / count(*) >= 0.5 from judged
union all select 'o_totalprice', 'dec', count(*) filter (o_totalprice is null), false
    from messy
union all select 'o_orderdate', 'dt', count(*) filter (o_orderdate is null), false
    from messy"""


def _dedup(order: str) -> str:
    return f"""select * from events
        qualify row_number() over (partition by user_id, event_type order by {order}) = 1"""


def oracle_sql() -> dict[str, str]:
    maltese = f"translate(c_name, '{_TO_MALTESE[0]}', '{_TO_MALTESE[1]}')"
    return _LLM_ORACLES | {
        "q_date_normalize": f"select o_orderkey, {_CLEAN_DATE} as d from orders",
        "q_date_only": f"select o_orderkey, cast({_CLEAN_DATE} as date) as d from orders",
        "q_date_day_first": "select o_orderkey, cast(o_orderdate as date) as d from orders",
        "q_date_half_day": "select event_id, date_trunc('second', ts) as d from events",
        "q_trim_collapse": rf"""select p_partkey,
            trim(regexp_replace({_MESSY_PART}, '\s+', ' ', 'g')) as p_name from part""",
        "q_trim_documents": r"""select doc_id,
            trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents""",
        "q_combine": """select c_custkey, c_name,
            case when c_custkey % 5 <> 0 then c_mktsegment end as seg,
            concat_ws('-', cast(c_custkey as varchar), c_name,
                case when c_custkey % 5 <> 0 then c_mktsegment end) as label
            from customer""",
        "q_combine_double": """select o_orderkey, o_totalprice, o_totalprice * 1000 as mills,
            concat_ws('|', cast(o_totalprice as varchar),
                cast(o_totalprice * 1000 as varchar)) as label from orders""",
        "q_split_whitespace": """select p_partkey, string_split(p_name, ' ')[1] as p_name_1,
            string_split(p_name, ' ')[2] as p_name_2 from part""",
        "q_split_exact": "select page_id, "
        + ", ".join(f"string_split(url, '/')[{i}] as url_{i}" for i in range(1, 7))
        + " from pages",
        "q_remove": "select c_custkey, c_name, c_mktsegment from customer",
        "q_rename": """select c_custkey, c_name as name, c_nationkey, c_acctbal,
            c_mktsegment from customer""",
        "q_dedup_first": _dedup("event_id"),
        "q_dedup_last": _dedup("event_id desc"),
        "q_dedup_all": "select distinct o_orderstatus, o_orderpriority from orders",
        "q_dedup_file_order": """select * from events
            qualify row_number() over (partition by user_id order by event_id) = 1""",
        "q_dedup_documents": """select doc_id, text, lang from documents
            qualify row_number() over (partition by text order by doc_id) = 1""",
        "q_profile": _PROFILE.format(sample=""),
        "q_profile_sampled": _PROFILE.format(sample="order by o_orderkey limit 200"),
        "q_preview": """select * from orders
            order by md5(concat(cast(o_orderkey as varchar), ':42')), o_orderkey
            limit 250""",
        "q_text_datetime": """select o_orderkey,
            strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as d from orders""",
        "q_csv": _ORDERS_AS_TEXT,
        "q_csv_quoted": "select * from documents",
        "q_tsv": """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts, user_id,
            event_type, value, props from events""",
        "q_json_lines": _ORDERS_AS_TEXT,
        "q_parquet": "select * from orders",
        "q_workbook": "select * from orders",
        "q_late_text": """select case when l_orderkey = (select max(l_orderkey) from lineitem)
                then 'late' else cast(l_orderkey as varchar) end as l_orderkey,
            cast(l_linenumber as varchar) as l_linenumber,
            cast(l_quantity as varchar) as l_quantity from lineitem""",
        "q_charset": f"select c_custkey, {maltese} as c_name from customer",
        "q_json_charset": f"""select {maltese} as "ħz", c_custkey as "ġb", 1 as a,
            'ħz,ġb,a' as order_read from customer""",
        "q_charset_mixed": f"select c_custkey, {maltese} as c_name from customer",
        "q_charset_census": """
            select true as utf8, '' as possible, 'UTF-8' as charset,
                false as ambiguous from customer where c_custkey % 2 = 0
            union
            select false, 'ISO-8859-3,ISO-8859-1', 'ISO-8859-3', true
                from customer where c_custkey % 2 = 1""",
        "q_charset_census_files": """
            select distinct c_mktsegment as segment, length(c_mktsegment) % 2 = 0 as utf8,
                case length(c_mktsegment) % 2 when 0 then '' else 'ISO-8859-3,ISO-8859-1' end
                    as possible,
                case length(c_mktsegment) % 2 when 0 then 'UTF-8' else 'ISO-8859-3' end as charset,
                length(c_mktsegment) % 2 = 1 as ambiguous, false as undecodable
            from customer""",
        "q_csv_one_column": """
            select case when c_custkey % 7 = 0 then ''
                when c_custkey % 3 <> 0 then c_name end as note from customer""",
        "q_csv_splits": "select doc_id, text, lang from documents",
        "q_recipe_refused": "select o_orderkey, o_orderstatus, true as refused from orders",
        "q_recipe": f"""select o_orderkey, signed_up, split_part(c_name, '#', 1) as kind,
            split_part(c_name, '#', 2) as code from ({_SIGNUPS})""",
        "q_recipe_prefix": f"""select o_orderkey, replace(c_name, '#', ' ') as full_name,
            signed_up from ({_SIGNUPS})""",
        "q_recipe_files": f"""select o_orderkey,
            strftime(signed_up, '%Y-%m-%dT%H:%M:%S') as signed_up,
            split_part(c_name, '#', 1) as kind,
            cast(split_part(c_name, '#', 2) as bigint) as code from ({_SIGNUPS})""",
        "q_lineage": f"""with messy as (select {_CLEAN_DATE} as moment,
                case when o_orderkey % 8 = 6 then 'garbage' else concat(
                    strftime(o_orderdate, '%Y%m%d'),
                    -- the short and the long name of May are the same
                    case when o_orderkey % 8 = 2 and month(o_orderdate) = 5 then 1
                        else o_orderkey % 8 end,
                    case when o_orderkey % 8 = 4
                        then strftime(o_orderdate, '%H%M%S') end) end as spelling
            from orders)
            select count(*) as rows_in, count(*) as rows_out,
                count(*) filter (moment is null) as nulls from messy
            union all
            select count(*), count(distinct spelling), 0 from messy""",
        "q_stream_recipe": """select p_partkey, p_brand, p_size,
            split_part(p_name, ' ', 1) as first, split_part(p_name, ' ', 2) as p_name_2,
            concat_ws('-', p_brand, cast(p_size as varchar)) as label from part""",
        "q_stream_keep_first": "select distinct user_id, event_type from events",
        "q_stream_run": f"""select event_id, ts, user_id, event_type as kind, value,
            concat_ws(':', event_type, user_id) as label
            from ({_dedup("ts desc, event_id desc")})""",
        "q_stream_keep_last": _dedup("event_id desc"),
    }
