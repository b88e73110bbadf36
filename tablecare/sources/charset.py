"""Text files in legacy charsets.

A census tells per file whether its bytes are UTF-8 and which of the caller's
candidate charsets could have produced them. Charsets are never guessed from
letter statistics: short files decode "successfully" under several charsets, and
the census says so instead of picking one silently.

Files are read once, in splits, so a large file is spread over many tasks; what these say
of its lines is put together by file. This is safe: in UTF-8 and in the single-byte and East Asian charsets the byte
0x0A is always a line break. UTF-16 is recognised by its byte order mark.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.functions.columns import ROW_ORDER
from tablecare.session import configure, scratch_path
from tablecare.sources.files import Paths, as_list, literal_path, text_order

# Charsets Spark reads without further permission (fixed values).
_STANDARD = (
    "US-ASCII",
    "ISO-8859-1",
    "UTF-8",
    "UTF-16BE",
    "UTF-16LE",
    "UTF-16",
    "UTF-32",
)
# Names that Java and Python do not share (fixed values), Java name first.
_PYTHON_CODECS = {
    "x-SJIS_0213": "shift_jis_2004",
    "x-MacRoman": "mac_roman",
    "x-windows-874": "cp874",
    "x-windows-949": "cp949",
    "x-windows-950": "cp950",
}


_VERDICT = ("path", "utf8", "marked", "zeros", "fitting")


def allow_charset(spark: SparkSession, charset: str | None) -> None:
    """Let Spark read a charset beyond its standard ones."""
    if charset and charset.upper() not in _STANDARD:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def is_wide(charset: str | None) -> bool:
    """Whether a line break is more than one byte, so that files cannot be split."""
    return bool(charset) and charset.upper().startswith(("UTF-16", "UTF-32"))


def transcode_lines(spark: SparkSession, paths: list[str], charset: str) -> str:
    """Write the lines of files in a wide charset as UTF-8 to the scratch folder.

    For sources that cannot read such charsets themselves. The new files, taken
    in path order, hold the lines in the order of the old ones.
    """
    lines = (
        spark.read.option("encoding", charset)
        .option("multiLine", "true")
        # the whole line is one field: no quotes, and a separator never used
        .option("quote", "")
        .option("sep", "\u0001")
        .schema("value string")
        .csv(paths)
        .withColumn(ROW_ORDER, text_order())
    )
    folder = scratch_path(spark, "transcoded")
    lines.orderBy(ROW_ORDER).select("value").write.text(folder)
    return folder


def _verdicts(candidates: Sequence[str]):
    """What the lines of each file in a batch say: whether they are UTF-8, begin with a
    byte order mark, hold zero bytes, and which candidates decode all of them."""
    codec_names = [_PYTHON_CODECS.get(c, c) for c in candidates]
    for name in codec_names:
        codecs.lookup(name)  # an unknown charset fails here, not in a task

    def decodes(text: bytes, name: str) -> bool:
        try:
            text.decode(name)
        except UnicodeDecodeError:
            return False
        return True

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[str, list] = {name: [] for name in _VERDICT}
        for batch in batches:
            path = batch.column("path").dictionary_encode()
            for number, file in enumerate(path.dictionary.to_pylist()):
                own = batch.filter(pc.equal(path.indices, number))
                # in one piece: 0x0A is a line break in all charsets that are tested
                odd = b"\n".join(own.column("odd").drop_null().to_pylist())
                told["path"].append(file)
                told["utf8"].append(pc.all(own.column("valid")).as_py())
                told["marked"].append(pc.any(own.column("marked")).as_py())
                told["zeros"].append(pc.any(own.column("zeros")).as_py())
                told["fitting"].append([decodes(odd, name) for name in codec_names])
        types = [pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.bool_())]
        columns = [pa.array(told[n], t) for n, t in zip(_VERDICT, types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=list(_VERDICT))

    return look


def charset_census(
    spark: SparkSession,
    path: Paths,
    candidates: Sequence[str] = (),
    overrides: Mapping[str, str] | None = None,
    recursive: bool = False,
) -> DataFrame:
    """One row per non-empty file: ``path, utf8, possible, charset, ambiguous,
    undecodable``.

    ``possible`` lists the candidates that decode every line strictly, in the
    caller's order; the first one becomes ``charset``. ``overrides`` maps a path
    pattern (``%`` for anything) to its known charset. A file nothing decodes
    is ``undecodable`` and gets ``UTF-8``, read with replacement characters.
    """
    configure(spark)
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    line = F.col("value").cast("binary")

    def holds(hexadecimal: str, test=F.contains) -> Column:
        return test(line, F.unhex(F.lit(hexadecimal)))

    at_start = F.col("_metadata.file_block_start") == 0
    # every line whose meaning a charset could change
    plain = F.decode(line, "ISO-8859-1").rlike(r"^[\x00-\x7f]*$")
    lines = reader.text(as_list(path)).select(
        F.col("_metadata.file_path").alias("path"),
        F.is_valid_utf8("value").alias("valid"),
        (at_start & (holds("FFFE", F.startswith) | holds("FEFF", F.startswith))).alias("marked"),
        holds("00").alias("zeros"),
        F.when(~plain, line).alias("odd"),
    )
    schema = "path string, utf8 boolean, marked boolean, zeros boolean, fitting array<boolean>"
    told = lines.mapInArrow(_verdicts(candidates), schema)
    fitting = [
        F.when(F.bool_and(F.get("fitting", F.lit(i))), F.lit(c)) for i, c in enumerate(candidates)
    ]
    possible = F.array_compact(F.array(*fitting)) if candidates else F.array()
    files = told.groupBy("path").agg(
        F.bool_and("utf8").alias("utf8"),
        F.bool_or("marked").alias("marked"),
        F.bool_or("zeros").alias("zeros"),
        possible.cast("array<string>").alias("fitting"),
    )
    possible = F.col("fitting")
    none = F.array().cast("array<string>")
    utf16 = ~F.col("utf8") & F.col("marked") & F.col("zeros")
    known = F
    for pattern, charset in (overrides or {}).items():
        known = known.when(F.col("path").like(pattern), F.lit(charset))
    known = known.when(F.col("utf8"), F.lit("UTF-8")).when(utf16, F.lit("UTF-16"))
    return (
        files.withColumn(
            "possible", F.when(F.col("utf8") | utf16, none).otherwise(possible)
        )
        .withColumn("found", known.otherwise(F.get("possible", F.lit(0))))
        .select(
            "path",
            "utf8",
            "possible",
            F.coalesce("found", F.lit("UTF-8")).alias("charset"),
            (F.size("possible") > 1).alias("ambiguous"),
            F.col("found").isNull().alias("undecodable"),
        )
    )


def paths_by_charset(census: DataFrame) -> dict[str, list[str]]:
    """Reading lists per charset, for the ``charsets`` option of a text source.

    This holds file names, one per file, as Spark's own file listing does.
    """
    groups: dict[str, list[str]] = {}
    for row in census.orderBy("path").select("path", "charset").toLocalIterator():
        # the metadata column gives a URI with escapes, a reader takes a path
        groups.setdefault(row["charset"], []).append(literal_path(unquote(row["path"])))
    return groups
