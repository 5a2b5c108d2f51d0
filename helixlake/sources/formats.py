"""Readers of sequence and alignment files, a record of the file being a row, and of lists.

Spark splits the files at the end of a record, so that a file of any size is read in parallel; only a gzip file is one task.
The parsers are expressions over a column of records and can be used on any table of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Formats by name, and what ends a record of each.
ENDS = {"fasta": "\n>", "genbank": "\n//", "ddbj": "\n//", "embl": "\n//", "uniprot": "\n//", "stockholm": "\n//"}


def sniffed(path: Column, first_line: Column) -> Column:
    """The format of a sequence file by its suffix (.gz apart) or else its first line that is not blank; null if neither tells."""
    suffix = F.regexp_extract(F.regexp_replace(path, r"\.gz$", ""), r"(\.[^.]*)$", 1)
    return (
        F.when(suffix == ".fa", "fasta").when(suffix == ".gb", "genbank").when(first_line.startswith(">"), "fasta").when(first_line.startswith("ID   "), "embl")
        .when(first_line.startswith("LOCUS   ") | first_line.contains("Genetic Sequence Data Bank"), "genbank")
    )


def _of_lines(record: Column, keep: str) -> Column:
    """The rest of each line of a record that a pattern matches, as an array."""
    return F.regexp_extract_all(record, F.lit(f"(?m)^{keep}(.*)$"), F.lit(1))


def _joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.rtrim(x)), " ")


def _body(record: Column, start: str) -> Column:
    """The letters and stars after the line that begins with a word; an error where a record lacks it."""
    found = F.regexp_extract(record, rf"(?s)(?:^|\n){start}[^\n]*(?:\n(.*))?$", 1)
    has = record.rlike(rf"(?:^|\n){start}")
    return F.when(has, F.regexp_replace(found, "[^A-Za-z*]", "")).otherwise(F.raise_error(F.lit(f"a record has no {start.strip()} line")))


def parse_fasta(records: DataFrame, record: str = "record") -> DataFrame:
    """name, desc, seq; records without a name are left out."""
    marked = F.col(record)
    texts = records.select(F.replace(F.when(marked.startswith(">"), marked.substr(F.lit(2), F.length(marked))).otherwise(marked), F.lit("\r"), F.lit("")).alias("plain"))
    # A header has one name or none, and a row is made for each: a filter on the name would be pushed down to where records are written, and write each once more.
    names = F.regexp_extract_all(F.ltrim(F.substring_index("plain", "\n", 1)), F.lit(r"^(\S+)"), F.lit(1))
    named = texts.select("plain", F.substring_index("plain", "\n", 1).alias("first"), F.explode(names).alias("name"))
    header = F.ltrim("first")
    lines = F.split(F.substring("plain", F.length("first") + 2, F.length("plain")), "\n")
    return named.select("name", F.trim(F.regexp_extract(header, r"^\S+\s+(.*)$", 1)).alias("desc"), F.array_join(F.transform(lines, lambda x: F.trim(x)), "").alias("seq"))


def parse_genbank(records: DataFrame, record: str = "record") -> DataFrame:
    """name, desc, seq of GenBank and DDBJ records; what stands outside of records is left out."""
    r = F.regexp_replace(record, "\r", "")
    entries = records.select(r.alias("r")).filter(F.col("r").rlike("(?:^|\n)LOCUS   "))
    r = F.col("r")
    name = F.regexp_extract(r, r"(?m)^LOCUS   .{4} *([^ \n]+)", 1)
    head = F.regexp_extract(r, r"(?s)^(.*?)(?:\nORIGIN|$)", 1)
    return entries.select(F.when(name != "", name).otherwise(F.raise_error(F.lit("a LOCUS line has no name"))).alias("name"), _joined(_of_lines(head, "DEFINITION  ")).alias("desc"), _body(r, "ORIGIN").alias("seq"))


def parse_embl(records: DataFrame, record: str = "record") -> DataFrame:
    """name, desc, seq of EMBL and UniProt records."""
    entries = records.select(F.regexp_replace(record, "\r", "").alias("r")).filter(F.col("r").rlike(r"\S") & ~F.col("r").rlike(r"^\s*//\s*$"))
    r = F.col("r")
    name = F.regexp_extract(r, r"^\s*ID   [ ;]*([^ ;\n]+)", 1)
    head = F.regexp_extract(r, r"(?s)^(.*?)(?:\nSQ   |$)", 1)
    return entries.select(F.when(name != "", name).otherwise(F.raise_error(F.lit("a record has no ID line"))).alias("name"), _joined(_of_lines(head, "DE   ")).alias("desc"), _body(r, "SQ   ").alias("seq"))


PARSERS = {"fasta": parse_fasta, "genbank": parse_genbank, "ddbj": parse_genbank, "embl": parse_embl, "uniprot": parse_embl}


def read_records(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.option("lineSep", ENDS[fmt]).text(path).withColumnRenamed("value", "record")


def read_sequences(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """name, desc, seq of a file in a format that is given, or told by its name or first line."""
    if fmt is None:
        first = spark.read.text(path).filter(F.trim("value") != "").select(sniffed(F.lit(path), F.col("value"))).head(1)
        fmt = first[0][0] if first else None
    if fmt is None or fmt.lower() not in PARSERS:
        raise ValueError(f"the format of {path} is not known")
    return PARSERS[fmt.lower()](read_records(spark, path, fmt.lower()))


def read_sequences_or_rows(spark: SparkSession, path: str) -> DataFrame:
    """name, seq of a sequence file, or of the rows of an alignment file without their gaps."""
    first = spark.read.text(path).filter(F.trim("value") != "").head(1)
    if first and first[0][0].startswith("# STOCKHOLM"):
        return read_stockholm(spark, path)[0].select("name", F.regexp_replace("aseq", "[-_.~]", "").alias("seq"))
    return read_sequences(spark, path).select("name", "seq")


def parse_stockholm(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (aln_id, name, idx, aseq), and annotations (aln_id, kind, name, tag, value), of lines (aln_id, line_no, line).

    Blocks of one row, and of one GC or GR annotation, are put together in the order of the lines; GF and GS texts of one
    tag are lines of one value. A row's idx is its place among the alignment's rows, from 0. A line may stand for several (`times`, as `writers.stockholm` tells
    them) that follow each other in its row.
    """
    text = F.rtrim("line")
    times = F.col("times") if "times" in lines.columns else F.lit(1)
    marked = lines.select("aln_id", "line_no", text.alias("line"), times.alias("times")).filter("line <> '' and line <> '//' and not line like '# STOCKHOLM%'")
    fields = F.split("line", r"[ \t]+", -1)
    kind = F.when(F.col("line").startswith("#="), F.substring("line", 3, 2)).when(F.col("line").startswith("#"), "comment").otherwise("row")
    rest = lambda skipped: F.regexp_extract("line", rf"^(?:\S+[ \t]+){{{skipped}}}(.*)$", 1)
    typed = marked.withColumn("kind", kind).filter("kind <> 'comment'")
    typed = typed.select(
        "aln_id", "line_no", "kind", "times",
        F.when(F.col("kind").isin("GS", "GR"), fields[1]).when(F.col("kind") == "row", fields[0]).alias("name"),
        F.when(F.col("kind").isin("GF", "GC"), fields[1]).when(F.col("kind").isin("GS", "GR"), fields[2]).alias("tag"),
        F.when(F.col("kind") == "row", rest(1)).when(F.col("kind").isin("GF", "GC"), rest(2)).otherwise(rest(3)).alias("value"),
    )
    values = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda x: x["value"]).alias("values")
    # Lines of a row are sent to it once, and rows are numbered by their names and first lines alone, so that no text is sorted by alignment.
    of = typed.filter("kind = 'row'")
    texts = of.select("aln_id", "name", "line_no", "value", "times").repartition("aln_id", "name").groupBy("aln_id", "name").agg(F.collect_list(F.struct("line_no", "value", "times")).alias("values"))
    first = of.groupBy("aln_id", "name").agg(F.min("line_no").alias("first"))
    first = first.select(F.col("aln_id").alias("__a"), F.col("name").alias("__n"), (F.row_number().over(Window.partitionBy("aln_id").orderBy("first")) - 1).alias("idx"))
    rows = texts.join(first, F.col("aln_id").eqNullSafe(F.col("__a")) & (F.col("name") == F.col("__n"))).select("aln_id", "name", "idx", F.array_join(F.transform(F.array_sort("values"), lambda x: F.repeat(x["value"], x["times"])), "").alias("aseq"))
    together = typed.filter("kind <> 'row'").groupBy("aln_id", "kind", "name", "tag").agg(values)
    notes = together.select("aln_id", "kind", "name", "tag", F.when(F.col("kind").isin("GC", "GR"), F.array_join("values", "")).otherwise(F.array_join("values", "\n")).alias("value"))
    return rows, notes


def cutoffs(notes: DataFrame) -> DataFrame:
    """aln_id, tag (GA, TC or NC), first, second: an alignment's score cutoffs; undefined ones are null."""
    values = F.split(F.trim("value"), r"[ \t]+")
    number = lambda i: F.get(values, i).try_cast("double")
    return notes.filter("kind = 'GF' and tag in ('GA', 'TC', 'NC')").select("aln_id", "tag", number(F.lit(0)).alias("first"), number(F.lit(1)).alias("second"))


def read_stockholm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and annotations of all alignments of a file; aln_id is the place of the alignment's record."""
    records = read_records(spark, path, "stockholm").filter(F.col("record").contains("# STOCKHOLM")).withColumn("aln_id", F.monotonically_increasing_id())
    return parse_stockholm(records.select("aln_id", F.posexplode(F.split("record", "\n")).alias("line_no", "line")))


def parse_clans(lines: DataFrame, line: str = "line") -> DataFrame:
    """clan, model of every member that lines list; # begins a comment. A model in two places, and no clan at all, are errors."""
    words = F.filter(F.split(F.regexp_replace(line, "#.*", ""), r"\s+"), lambda w: w != "")
    members = lines.select(words.alias("w")).filter("size(w) > 0").select(F.col("w")[0].alias("clan"), F.explode(F.slice("w", 2, 1_000_000)).alias("model"))
    twice = members.groupBy("model").count().filter("count > 1").head(1)
    if twice:
        raise ValueError(f"model {twice[0][0]} is listed twice")
    if not members.head(1):
        raise ValueError("no clans")
    return members


def parse_keys(lines: DataFrame, line: str = "line") -> DataFrame:
    """key, position of every line's first word, in order of line_no."""
    word = F.regexp_extract(line, r"^\s*(\S+)", 1)
    return lines.select("line_no", word.alias("key")).filter("key <> ''")
