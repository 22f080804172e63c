"""Inputs of the registered queries: the given tables, and views derived from them.

The driver tables are clean, so dirt, messages, file listings and query logs
are derived row by row from whole tables; their size follows the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleansheet.session import rename_files, scratch_path, stored_bytes

BYTES_PER_TASK = 4 << 20

MESSY_HEADINGS = [
    "Order ID", " Priority (!)", "Confirmed?", "Amount $", "QTY", "Order  Day", "Empty_Col", "const__col",
]
MESSY_COLUMNS = ["order_id", "priority", "confirmed", "amount", "qty", "order_day", "empty_col", "const_col"]

# One text per audit rule, and some that break none. `{u}` becomes the user id.
QUERY_TEXTS = (
    "select * from t{u}",
    "SELECT a FROM t{u}",
    "delete from t{u}",
    "update t{u} set a = 1",
    "truncate table t{u}",
    "drop table t{u}",
    "select a from t where b = NULL and c = {u} limit 5",
    "select a from t where b like '%x{u}' limit 5",
    "select a from t where b = {u} order by a",
    "select a from t where year(d) = 20{u} limit 5",
    "select a from t{u}, u where t{u}.i = u.i limit 5",
    "select a from t cross join u where b = {u} limit 5",
    "select a from t join u where b = {u} limit 5",
    "select a from t where b = {u} having count(*) > 1 limit 5",
    "select (a from t where b = {u} limit 5",
    "select a from t where b = {u} or 1 = 1 limit 5",
    "select a from t where b = {u}; drop table u",
    "select {u}",
    "select distinct a from t where b = {u} limit 5",
    "select a from t where b = 'it (is) from * {u}' limit 5",
    "select a\n  from t\n where b = {u}\n limit 5",
    "select a from t join u on t.i = u.i where b = {u} limit 5",
    "select a from t where b is null and c = {u} group by a having count(*) > 1 limit 5",
    "insert into t values ({u})",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Some columns of a table, dealt to all cores, and to more tasks the larger its file is.

    The given tables are single files of one row group, which one core would
    read and work on alone; tables at scale need no such step.
    """
    df = table(spark, folder, name)
    tasks = max(spark.sparkContext.defaultParallelism, stored_bytes(spark, f"{folder}/{name}.parquet") // BYTES_PER_TASK)
    return (df.select(*columns) if columns else df).repartition(tasks)


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with dirt of every kind, in one scan.

    Whitespace, missing tokens, mixed case, thousands separators, unparsable
    cells, exact copies, empty rows, an empty and a constant column.
    """
    o = shared_table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    key = F.col("o_orderkey")

    def every(n: int, at: int = 0) -> Column:
        return key % n == at

    thousands = F.floor(F.col("o_totalprice") / 1000).cast("bigint").cast("string")
    units = F.lpad((F.floor("o_totalprice").cast("bigint") % 1000).cast("string"), 3, "0")
    dirty = o.select(
        key.alias("order_id"),
        F.when(every(11), "-").when(every(13), "  ").when(every(19), None)
        .otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("  x "))).alias("priority"),
        F.when(every(3), "yes").when(every(3, 1), "YES").otherwise(" No ").alias("confirmed"),
        F.when(every(23), "N/A").when(every(29), "1d")
        .otherwise(F.concat(thousands, F.lit(","), units)).alias("amount"),
        F.when(every(7), None).otherwise((key % 50).cast("double")).alias("qty"),
        F.when(every(31), "soon").otherwise(F.col("o_orderdate").cast("date").cast("string")).alias("order_day"),
        F.lit(None).cast("string").alias("empty_col"),
        F.lit("x").alias("const_col"),
        F.filter(
            F.array(F.lit(True), F.when(every(17), True), F.when(every(1000, 1), False)),
            lambda real: real.isNotNull(),
        ).alias("versions"),
    )
    rows = dirty.withColumn("real", F.explode("versions"))
    return rows.select(*[F.when(F.col("real"), F.col(c)).alias(c) for c in MESSY_COLUMNS])


def messy_with_headings(spark: SparkSession, folder: str) -> DataFrame:
    return messy_orders(spark, folder).toDF(*MESSY_HEADINGS)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Events as command history."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("command"),
        F.col("value").alias("execution_time"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("success"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("duration_ms"),
        F.col("ts").alias("created_at"),
    )


def chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as messages to the bot, most of them commands."""
    form = (F.col("conv_id") + F.col("turn")) % 8
    said = (
        F.when(form == 0, F.concat(F.lit("<@U1> explain "), "text"))
        .when(form == 1, F.concat(F.lit("<@U1> CLEAN   "), "text"))
        .when(form == 2, F.concat(F.lit("<@U1> cleanup "), "text"))
        .when(form == 3, F.lit("<@U1> optimize"))
        .when(form == 4, F.concat(F.lit("hello <@U1> "), "text"))
        .when(form == 5, F.concat(F.lit("  Validate <@U2>\n"), "text"))
        .when(form == 6, F.concat(F.lit("<@U1>generate"), "text"))
        .otherwise(F.col("text"))
    )
    return table(spark, folder, "conversations").select("conv_id", "turn", said.alias("text"))


def file_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as messages that share up to three files."""
    key = F.col("doc_id")
    stem = F.concat_ws("_", "source", "lang", key.cast("string"))

    def file(suffix: Column) -> Column:
        name = F.concat(stem, suffix)
        return F.struct(name.alias("name"), F.concat(F.lit("https://files/"), name).alias("url_private_download"))

    return table(spark, folder, "documents").select(
        "doc_id",
        F.when(key % 7 == 0, "message").otherwise("file_share").alias("subtype"),
        F.array(
            file(F.when(key % 5 == 0, ".csv").otherwise(".txt")),
            file(F.when(key % 3 == 0, ".CSV").otherwise(".csv.zip")),
            file(F.when(key % 2 == 0, "b.Csv").otherwise(".png")),
        ).alias("files"),
    )


def uploaded_names(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as uploads; many share a name within one second."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.concat(
            F.lit("../data/"), F.when(F.col("doc_id") % 9 == 0, "???").otherwise(
                F.concat("source", F.lit(" répört ("), "lang", F.lit(")"))),
            F.lit(".v1.CSV"),
        ).alias("file_name"),
        (F.lit(1767225600) + F.floor(F.col("doc_id") / 100)).cast("bigint").alias("uploaded_second"),
    )


LANDED_FILES = 97


def land_documents(spark: SparkSession, folder: str) -> str:
    """Documents written to a landing folder of 97 files: some are empty, broken or have another extension."""
    parts, landing = scratch_path(spark, "parts"), scratch_path(spark, "landing")
    key, number = F.col("doc_id"), F.col("doc_id") % LANDED_FILES
    broken = (key % 7 == 0) & (number % 5 == 0)
    raw = F.when(broken, F.concat(F.unhex(F.lit("E920")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    lines = table(spark, folder, "documents").select(number.alias("file"), raw.cast("string").alias("value"))
    lines.repartition("file").write.partitionBy("file").text(parts)
    rename_files(spark, parts, landing, {f"file={n}": landed_name(n) for n in range(LANDED_FILES)},
                 empty=[landed_name(n) for n in range(LANDED_FILES) if n % 13 == 0])
    return landing


def landed_name(number: int) -> str:
    return f"f{number}" + (".txt" if number % 11 == 0 else ".CSV" if number % 3 == 0 else ".csv")


def query_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events and documents as a log of SQL texts; no two rows say the same.

    An event asks one of the texts above, with its kind and time in comments.
    A document's text, whole, becomes a comment, a literal, a quoted name, or
    stands in a query that is named before or put around the one that is asked.
    """

    def asked(key: Column, number: Column) -> Column:
        text = F.get(F.array(*[F.lit(q) for q in QUERY_TEXTS]), (key % len(QUERY_TEXTS)).cast("int"))
        return F.replace(text, F.lit("{u}"), number.cast("string"))

    key = F.col("event_id")
    sql = asked(key, F.col("user_id"))
    before = F.when(key % 3 == 0, F.concat(F.lit("/* "), "event_type", F.lit("; drop ( */ "))).otherwise("")
    stamp = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    after = F.when(key % 2 == 0, F.concat(F.lit(" -- at "), stamp, F.lit("; delete ' or 1=1"))).otherwise("")
    events = shared_table(spark, folder, "events", "event_id", "user_id", "event_type", "ts").select(
        key.alias("id"), "user_id", F.concat(before, sql, after).alias("input_text"))

    key = F.col("doc_id")
    sql, style = asked(key, F.col("n_chars")), F.floor(key / len(QUERY_TEXTS)) % 7
    literal = F.concat(F.lit("'"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("'"))
    name = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    comment = F.concat(F.lit("/*"), F.replace("text", F.lit("*/"), F.lit("")), F.lit("*/"))
    line = F.concat(F.lit("--"), F.translate("text", "\n", " "), F.lit("\n"))
    documents = table(spark, folder, "documents").select(
        (key + 1_000_000_000_000).alias("id"), (key % 97).alias("user_id"),
        F.when(style == 0, F.concat(comment, sql))
        .when(style == 1, F.concat(sql, F.lit(" "), line))
        .when(style == 2, F.concat(F.lit("with c as (select a from t where b = "), literal, F.lit(") "), sql))
        .when(style == 3, F.concat(F.lit("select x from ("), sql, F.lit(") as "), name, F.lit(" where x = 1 limit 1")))
        .when(style == 4, F.concat(F.replace(F.upper(sql), F.lit(" "), F.lit("\n\t ")), line))
        .when(style == 5, F.concat(F.lit("select a from t where b in ("), literal, F.lit(", ("), sql, F.lit(")) limit 3")))
        .otherwise(F.concat(F.lit("select a from t where b = "), literal, F.lit(" limit 1 union all "), sql)).alias("input_text"))
    return events.unionByName(documents)


def column_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as a table of untidy column names."""
    return table(spark, folder, "part").select(
        "p_partkey",
        F.concat(
            F.lit(" "), F.initcap("p_name"), F.lit(" – ("), "p_brand", F.lit(") Größe_"), F.col("p_size").cast("string"),
            F.lit("\xa0 %__"), F.lower("p_type"), F.lit(" "),
        ).alias("heading"),
    )


def text_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Messy orders as raw cells of several types, one column per kind."""
    mo = messy_orders(spark, folder)
    key = F.coalesce("order_id", F.lit(0).cast("bigint"))
    cells = {
        "whole": key.cast("string"),
        "whole_gap": F.when(key % 7 == 0, "NULL").otherwise(key.cast("string")),
        "big": (F.lit(9223372036854775807).cast("decimal(20,0)") + key).cast("string"),
        "huge": F.concat(F.lit("99999999999999999999"), key.cast("string")),
        "real": F.concat(key.cast("string"), F.lit(".5e-3")),
        "flag": F.when(key % 2 == 0, "TRUE").otherwise("false"),
        "flag_gap": F.when(key % 2 == 0, "True").when(key % 3 == 0, "n/a").otherwise("False"),
        "nothing": F.when(key % 2 == 0, "").otherwise("#N/A"),
        "almost": F.when(key % 5000 == 17, "1d").otherwise(key.cast("string")),
        **{c: F.col(c).cast("string") for c in MESSY_COLUMNS},
    }
    return mo.select(*[v.alias(f"c_{n}") for n, v in cells.items()])



# Forms of a date, as Spark and the second engine print it.
DATE_FORMS = (
    ("yyyy-MM-dd", "%Y-%m-%d"), ("M/d/yyyy", "%-m/%-d/%Y"), ("yyyy-M-d", "%Y-%-m-%-d"), ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ"), ("MMM d, yyyy", "%b %-d, %Y"), ("d MMMM yyyy", "%-d %B %Y"),
    ("yyyy-MM-dd HH:mm:ss'.25'", "%Y-%m-%d %H:%M:%S.25"), ("MM/dd/yyyy hh:mm a", "%m/%d/%Y %I:%M %p"),
    ("MMMM d yyyy HH:mm:ss", "%B %-d %Y %H:%M:%S"), ("yyyy/MM/dd HH:mm:ss'+02:00'", "%Y/%m/%d %H:%M:%S+02:00"),
    ("d MMM yyyy", "%-d %b %Y"), ("MM-dd-yyyy", "%m-%d-%Y"), ("yyyyMMdd", "%Y%m%d"), ("d-MMM-yyyy", "%-d-%b-%Y"),
    ("dd-MMM-yy", "%d-%b-%y"), ("M/d/yy", "%-m/%-d/%y"), ("M.d.yyyy", "%-m.%-d.%Y"), ("EEE, dd MMM yyyy", "%a, %d %b %Y"),
    ("MMM'.' d, yyyy", "%b. %-d, %Y"), ("MMMM yyyy", "%B %Y"), ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "%a, %d %b %Y %H:%M:%S GMT"),
    ("'on' yyyy", "on %Y"),
)


def dated_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a moment derived from day and key, printed in one form after the other."""
    key = F.col("o_orderkey")
    moment = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("date").cast("timestamp")) + key % 86400)
    text = F.lit(None).cast("string")
    for i, (form, _) in enumerate(DATE_FORMS):
        text = F.when(key % len(DATE_FORMS) == i, F.date_format(moment, form)).otherwise(text)
    return shared_table(spark, folder, "orders", "o_orderkey", "o_orderdate").select(key.alias("order_id"), text.alias("written"))


# Columns that each write dates in one way: Spark and second-engine form, years added, and a second form for every
# tenth value. Two columns leave the order of day and month open in many values, one writes most years in two digits.
DATE_COLUMNS = {
    "dotted": ("d.M.yyyy", "%-d.%-m.%Y", 0, None), "american": ("M/d/yy", "%-m/%-d/%y", 0, None),
    "future": ("d/M/yy", "%-d/%-m/%y", 80, ("d/M/yyyy", "%-d/%-m/%Y")), "packed": ("yyyyMMdd", "%Y%m%d", 0, None),
    "mail": ("EEE, dd MMM yyyy", "%a, %d %b %Y", 0, None), "named": ("d-MMM-yy", "%-d-%b-%y", 0, ("MMM d, yyyy", "%b %-d, %Y")),
    "month": ("MMMM yyyy", "%B %Y", 0, None), "words": ("'the' d MMMM", "the %-d %B", 0, None),
}


def dated_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The day of an order in several columns; every 40th is no date."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")

    def printed(form: str, years: int, other: tuple | None) -> Column:
        moved = F.add_months(day, 12 * years)
        text = F.date_format(moved, form)
        if other:
            text = F.when(key % 10 == 0, F.date_format(moved, other[0])).otherwise(text)
        return F.when(key % 40 == 3, "soon").otherwise(text)

    return shared_table(spark, folder, "orders", "o_orderkey", "o_orderdate").select(
        key.alias("order_id"), *[printed(f, y, o).alias(n) for n, (f, _, y, o) in DATE_COLUMNS.items()])
