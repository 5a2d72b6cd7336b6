"""Large indented documents, read by many tasks.

Documents that other programs write are one indented object per file, which a JSON
reader takes whole. Here Spark reads their lines, cut into splits like any text. How
deep a line lies follows from the brackets before it: they are summed within each
split, and over the splits of a file, of which there are few. So are the objects that
give an entry its number. Nothing depends on the width or style of the indentation,
only on entries not sharing lines with what encloses them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelane.functions.text import read_result_name
from scorelane.session import few, work_path

_STRING = r'"(?:[^"\\]|\\.)*+"'
_SCALAR = rf'({_STRING}|[^\s,\[\]{{}}"]+)'


def _count(text: Column, marks: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, marks, ""))).cast("bigint")


def _decoded(raw: Column) -> Column:
    """A JSON scalar as text; null for null."""
    return F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>", {"mode": "FAILFAST"})[0]


def document_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of each ``file`` with their ``depth``, and the objects opened up to their end.

    ``block`` and ``line`` give their order. The lines cross one shuffle, a split a task,
    and are kept. A file whose brackets do not close fails the job.
    """
    read = spark.read.text(path)
    split = F.struct("_metadata.file_path", "_metadata.file_block_start")
    lines = read.select(split.alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    bare = F.regexp_replace("value", _STRING, "")
    measured = lines.where(F.trim("value") != "").withColumns(
        {"opened": _count(bare, "{[") - _count(bare, "}]"), "objects": _count(bare, "{")}
    )
    own = Window.partitionBy("split").orderBy("at")
    up_to = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = measured.select(
        F.col("split.file_path").alias("file"),
        F.col("split.file_block_start").alias("block"),
        F.row_number().over(own).alias("line"),
        "value",
        "opened",
        (F.sum("opened").over(up_to) - F.col("opened")).alias("depth"),
        F.sum("objects").over(up_to).alias("objects"),
    )
    kept = work_path(spark, "lines")
    local.write.parquet(kept)
    stored = spark.read.schema(local.schema).parquet(kept)
    totals = stored.groupBy("file", "block").agg(F.sum("opened").alias("deep"), F.max("objects").alias("many"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file")
    before = totals.select(
        "file",
        "block",
        F.coalesce(F.sum("deep").over(earlier), F.lit(0)).alias("_deep"),
        F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("_many"),
        F.sum("deep").over(every).alias("_open"),
    )
    whole = F.raise_error(F.concat(F.lit("brackets do not close in "), F.col("file"))).cast("boolean")
    placed = stored.join(few(before, "line-offsets"), ["file", "block"])
    return placed.where(F.when(F.col("_open") == 0, True).otherwise(whole)).select(
        "file",
        "block",
        "line",
        "value",
        "opened",
        (F.col("depth") + F.col("_deep")).alias("depth"),
        (F.col("objects") + F.col("_many")).alias("objects"),
    )


def _keys(lines: DataFrame) -> DataFrame:
    """The lines that begin a member of their document's object: few per file."""
    key = F.regexp_extract("value", rf"^[\s,{{]*({_STRING})\s*:", 1)
    members = lines.where((F.col("depth") == 1) | ((F.col("depth") == 0) & F.col("value").contains(":")))
    return few(members.where(key != "").withColumn("key", _decoded(key)), "document-members")


def scalars(members: DataFrame, names: Sequence[str]) -> DataFrame:
    """The plain members of each file's object, a column each; null where there is none."""
    value = F.regexp_extract("value", rf":\s*{_SCALAR}\s*[,}}]?\s*$", 1)
    found = [
        F.max(F.when((F.col("key") == name) & (value != ""), _decoded(value))).alias(name) for name in names
    ]
    return members.groupBy("file").agg(*found)


def _sections(members: DataFrame, names: Sequence[str]) -> DataFrame:
    """Where the first of ``names`` that a file has begins and where it ends."""
    order = Window.partitionBy("file").orderBy("block", "line")
    place = F.struct("block", "line")
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("key"))
    ends = members.withColumns({"end": F.lead(place).over(order), "rank": rank, "start": place})
    wanted = ends.where(F.col("rank") > 0)
    best = wanted.groupBy("file").agg(
        F.min_by(F.struct("start", "end", "objects", "value", "opened"), "rank").alias("section")
    )
    opens = F.length(F.regexp_replace(F.col("section.value"), _STRING, ""))
    inside = F.regexp_replace(F.regexp_replace(F.col("section.value"), _STRING, ""), r"[\s,:\[\]{}]", "")
    packed = (F.col("section.opened") < 1) & ((inside != "") | F.col("section.value").rlike(rf"[\[{{]\s*{_STRING}"))
    fail = F.raise_error(F.concat(F.lit("entries share a line in "), F.col("file"))).cast("boolean")
    checked = best.where(F.when(packed & (opens > 0), fail).otherwise(True))
    objects = _count(F.regexp_replace(F.col("section.value"), _STRING, ""), "{")
    return few(
        checked.select(
            "file",
            F.col("section.start").alias("_start"),
            F.col("section.end").alias("_end"),
            (F.col("section.objects") - objects).alias("_objects"),
        ),
        "document-sections",
    )


def _inside() -> Column:
    """Whether a line is in its file's section, and not the one that begins it."""
    place = F.struct("block", "line")
    return (place > F.col("_start")) & (F.col("_end").isNull() | (place < F.col("_end")))


def indented_result_rows(spark: SparkSession, path: str) -> DataFrame:
    """``document``, ``sample_id``, ``prediction`` and ``label`` of indented result documents of any size.

    As ``result_rows`` gives them: of ``predictions_and_labels``, else of ``samples``.
    """
    lines = document_lines(spark, path)
    sections = _sections(_keys(lines), ["predictions_and_labels", "samples"])

    def value(name: str) -> Column:
        return F.regexp_extract("value", rf'"{name}"\s*:\s*{_SCALAR}', 1)

    values = {name: value(name) for name in ("prediction", "label")}
    held = lines.join(sections, "file").where(_inside()).withColumns(values)
    entries = held.where((F.col("prediction") != "") | (F.col("label") != ""))
    number = F.col("objects") - F.col("_objects") - 1
    rows = entries.groupBy(F.col("file").alias("document"), number.alias("sample_id")).agg(
        *(F.max(F.nullif(F.col(name), F.lit(""))).alias(name) for name in ("prediction", "label"))
    )
    return rows.withColumns({name: _decoded(F.col(name)) for name in ("prediction", "label")})


def indented_hint_rows(
    spark: SparkSession,
    path: str,
    dataset: str | None = None,
    split: str | None = None,
    datasets: Sequence[str] = (),
    splits: Sequence[str] = (),
) -> DataFrame:
    """The predictions of indented maps of any size, one row each.

    Columns are ``dataset``, ``split``, ``form_id``, ``audio_column``, ``sample_id``, ``hint``
    and ``place``, the order in the file, which tells the last of an id that is repeated.
    Names are found as ``read_hint_maps`` finds them. A line of the map that is no entry
    fails the job.
    """
    lines = document_lines(spark, path)
    members = _keys(lines)
    about = few(scalars(members, ["dataset", "split", "form_id", "audio_column"]), "map-members")
    pair = rf"^[\s,]*({_STRING})\s*:\s*{_SCALAR}[\s,}}]*$"
    held = lines.join(_sections(members, ["binary_predictions"]), "file")
    key, value = F.regexp_extract("value", pair, 1), F.regexp_extract("value", pair, 2)
    fail = F.raise_error(F.concat(F.lit("no entry in "), F.col("file"), F.lit(": "), F.col("value")))
    # Spark may look at other lines first, so the check itself says which ones it is about.
    entry = F.when(~_inside() | (F.col("depth") != 2), False).when(key != "", True)
    entry = entry.when(F.col("value").rlike(r"^[\s,\]}]*$"), False).otherwise(fail.cast("boolean"))
    rows = held.where(entry).join(about, "file")
    named = {"dataset": F.lit(dataset), "split": F.lit(split)}
    if datasets and splits:
        found = read_result_name(F.col("file"), datasets, splits)
        named = {name: F.coalesce(given, found[name]) for name, given in named.items()}
    return rows.select(
        *(F.coalesce(name, given).alias(name) for name, given in named.items()),
        "form_id",
        "audio_column",
        _decoded(key).try_cast("bigint").alias("sample_id"),
        _decoded(value).alias("hint"),
        F.struct("file", "block", "line").alias("place"),
    )
