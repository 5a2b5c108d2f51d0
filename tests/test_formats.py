"""Files of every format, read by their name or first line, and lists; literal values of histograms, tails, thresholds and scores."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixlake.functions import alphabet, stats
from helixlake.operators import columns, intervals, keys, models
from helixlake.sources import formats, writers

FASTA = ">seq1 a description\nACGTACGTAC\nGGGGTTTTAA\n>\nACGT\n>seq2\n\n>seq3  two words \n AC \n"
GENBANK = "LOCUS       seq1          20 bp    DNA\nDEFINITION  a description.\nVERSION     seq1.1\nORIGIN\n       1 acgtacgtac gggg\n       11 ttttaa\n//\nLOCUS       two\nDEFINITION  x\nDEFINITION  y\nORIGIN\n//\n"
EMBL = "ID   X06347; SV 1; linear; mRNA; STD; HUM; 20 BP.\nAC   X06347;\nDE   test description\nSQ   Sequence 20 BP;\n     acgtacgtac gggg ttttaa                20\n//\n"
STOCKHOLM = """# STOCKHOLM 1.0
#=GF ID   first
#=GF GA   10.5 20
#=GF NC   undefined
#=GS b WT 0.5
a ACG-U
b AC..U
#=GR a PP 98*.7
#=GC RF xxx.x

a GG
b -G
#=GC RF xx
//
# STOCKHOLM 1.0
c UU
//
"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sequence_files(spark, tmp_path):
    for name, text in (("a.txt", FASTA), ("b.txt", GENBANK), ("c.txt", EMBL)):
        (tmp_path / name).write_text(text)
    with gzip.open(tmp_path / "d.fa.gz", "wt") as f:
        f.write(FASTA)
    fasta = [("seq1", "a description", "ACGTACGTACGGGGTTTTAA"), ("seq2", "", ""), ("seq3", "two words", "AC")]
    assert rows(formats.read_sequences(spark, str(tmp_path / "a.txt"))) == fasta
    assert rows(formats.read_sequences(spark, str(tmp_path / "d.fa.gz"))) == fasta
    assert rows(formats.read_sequences(spark, str(tmp_path / "b.txt"))) == [("seq1", "a description.", "acgtacgtacggggttttaa"), ("two", "x y", "")]
    assert rows(formats.read_sequences(spark, str(tmp_path / "c.txt"), "EMBL")) == [("X06347", "test description", "acgtacgtacggggttttaa")]
    (tmp_path / "e.txt").write_text("nothing known\n")
    with pytest.raises(ValueError, match="format"):
        formats.read_sequences(spark, str(tmp_path / "e.txt"))
    (tmp_path / "f.gb").write_text("LOCUS       x\nDEFINITION  y\n//\n")
    with pytest.raises(Exception, match="ORIGIN"):
        formats.read_sequences(spark, str(tmp_path / "f.gb")).collect()


def test_fasta_records_are_written_once(spark):
    """The plan has one writer and one pass over a record's lines, and no filter that writes records again; odd records are read as before."""
    made = spark.range(3).select(writers.fasta(F.concat(F.lit("n"), "id"), F.lit("d"), F.repeat(F.translate(F.col("id").cast("string"), "012", "ACG"), 140)).alias("record"))
    plan = formats.parse_fasta(made)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(.{1,60})") == 1 and "Filter" not in plan
    odd = [None, "", ">", "\n", ">\nACG", "> \t\nACG", "\r>x\nAC", ">>x y\nAC", ">x", "x  a  b \r\n AC \r\n\r\n G G \n", ">  n\td e\n-*\n", ">é ü\nÄ C\n", ">xr\rz q\nA", ">x", ">x"]
    found = [(">x", "", "AC"), (">x", "y", "AC"), *[("x", "", "")] * 3, ("x", "a  b", "ACG G"), ("n", "d e", "-*"), ("é", "ü", "Ä C"), ("xrz", "q", "A")]
    assert rows(formats.parse_fasta(spark.createDataFrame([(x,) for x in odd], "record string"))) == sorted(found)


def test_stockholm_files(spark, tmp_path):
    (tmp_path / "a.sto").write_text(STOCKHOLM)
    found, notes = formats.read_stockholm(spark, str(tmp_path / "a.sto"))
    assert sorted((r.name, r.idx, r.aseq) for r in found.collect()) == [("a", 0, "ACG-UGG"), ("b", 1, "AC..U-G"), ("c", 0, "UU")]
    told = sorted((r.kind, r.name or "", r.tag, r.value) for r in notes.collect())
    assert told == [("GC", "", "RF", "xxx.xxx"), ("GF", "", "GA", "10.5 20"), ("GF", "", "ID", "first"), ("GF", "", "NC", "undefined"), ("GR", "a", "PP", "98*.7"), ("GS", "b", "WT", "0.5")]
    assert sorted((r.tag, r.first, r.second) for r in formats.cutoffs(notes).collect()) == [("GA", 10.5, 20.0), ("NC", None, None)]
    assert rows(formats.read_sequences_or_rows(spark, str(tmp_path / "a.sto"))) == [("a", "ACGUGG"), ("b", "ACUG"), ("c", "UU")]


def test_alignment_writers(spark):
    aln = spark.createDataFrame([("x", 0, "one", "ACG-U"), ("x", 1, "b", "AC-GU")], "aln_id string, idx long, name string, aseq string")
    assert [r.record for r in writers.a2m(aln).orderBy("idx").collect()] == [">one\nACGU\n", ">b\nAC-gU\n"]
    assert [r.line for r in writers.psiblast(aln, 3).orderBy("block", "idx").collect()] == ["one  ACG", "b    AC-", "one  -U", "b    gU"]
    assert [r.line for r in writers.clustal(aln).orderBy(F.asc_nulls_last("idx")).collect()] == ["one ACG-U", "b   AC-GU", "    **  *"]
    lines = [r.line for r in writers.stockholm(aln).orderBy("line_no").collect()]
    assert lines == ["# STOCKHOLM 1.0", "one ACG-U", "b   AC-GU", "//"]
    assert spark.range(1).select(writers.fasta(F.lit("n"), F.lit(""), F.lit("A" * 61))).first()[0] == ">n\n" + "A" * 60 + "\nA\n"


def test_clans_and_keys(spark):
    line = lambda *x: spark.createDataFrame([(t,) for t in x], "line string")
    assert rows(formats.parse_clans(line("# comment", "", "c1 a b # d", "c2 e"))) == [("c1", "a"), ("c1", "b"), ("c2", "e")]
    with pytest.raises(ValueError, match="twice"):
        formats.parse_clans(line("c1 a", "c2 a"))
    with pytest.raises(ValueError, match="no clans"):
        formats.parse_clans(line("# nothing"))
    index = spark.createDataFrame([("tRNA", 0), ("Vault", 49711), ("tRNA-Sec", 321100), ("rnaseP-eubact", 115956)], "name string, at long")
    aliases = spark.createDataFrame([("RF00005", "tRNA"), ("RF00006", "Vault"), ("RF01852", "tRNA-Sec")], "alias string, key string")
    wanted = spark.createDataFrame([("RF00006", 1), ("tRNA", 2), ("none", 3)], "key string, line_no long")
    assert [(r.line_no, r.name, r["at"]) for r in keys.fetch(index, "name", aliases, wanted).orderBy("line_no").collect()] == [(1, "Vault", 49711), (2, "tRNA", 0)]
    assert {r.ordinal: r.name for r in keys.numbered(index, "name").collect()} == {0: "Vault", 1: "rnaseP-eubact", 2: "tRNA", 3: "tRNA-Sec"}
    assert keys.duplicates(index, "name").count() == 0


SCORES = [0.5, 1.2, 2.3, 0.1, 3.4, 5.6, 2.1, 4.4, 1.1, 6.7, 3.3, 2.2, 0.9, 7.8, 5.5, 4.1, 3.9, 2.7, 1.8, 8.2]


def test_tails_and_histograms(spark):
    sample = lambda v: spark.createDataFrame([("g", float(x)) for x in v], "g string, x double")
    fit = columns.exponential_fit(columns.tail(sample(SCORES), "g", "x", 0.5), "g", "x").first()
    assert fit.n == 10 and fit.mu == 3.3 and fit["lambda"] == pytest.approx(0.50251256281407042, rel=1e-12)
    cdf = spark.range(1).select(stats.exponential_cdf(F.lit(4.3), 3.3, 0.50251256281407042)).first()[0]
    assert cdf == pytest.approx(0.39499137376548188, rel=1e-12)
    of = lambda mass: sorted(r.x for r in columns.tail(sample(range(1, 11)), "g", "x", mass).collect())
    assert of(0.5) == [6, 7, 8, 9, 10] and of(0.33) == [8, 9, 10]
    assert columns.histogram(spark.createDataFrame([("g", -99.95 + 100)], "g string, x double"), "g", "x", 0.1).first().bin == 0
    one = columns.gumbel_newton(sample([1.0]), "g", "x").first()
    assert one.n == 1 and one.mu is None


def test_thresholds_scores_and_checks(spark):
    get = lambda c: spark.range(1).select(c.alias("v")).first().v
    tier = lambda z, mode="default": get(stats.filter_thresholds(F.lit(z), F.lit(mode)))
    assert (tier(1.0).f1, tier(1.0).f2, tier(1.0).f3) == (0.35, None, 0.02) and (tier(5.8).f1, tier(5.8).f3) == (0.35, 0.005) and (tier(50.0).f2, tier(50.0).f3) == (0.15, 0.003)
    assert tier(2.0 - 1e-7).f3 == 0.005 and tier(3e4).f3 == 0.0002 and tier(1.0, "rfam").f1 == 0.06 and tier(1.0, "mid").f3 == 0.02 and tier(1.0, "max").f3 == 1.0
    null3 = lambda s: get(stats.null3(F.lit(len(s)), [alphabet.frequency(F.lit(s), r) for r in "ACGU"]))
    assert null3("ACGUACGU") == pytest.approx(0, abs=1e-4) and null3("AAAAAAAA") == pytest.approx(1.0)
    assert [get(alphabet.frequency(F.lit(""), r)) for r in "ACGU"] == [0.25] * 4
    assert get(models.base_pairs(F.lit("<(A.>a)"))) is None and [(p.i, p.j) for p in get(models.base_pairs(F.lit("<<A>.a>")))] == [(2, 4), (3, 6), (1, 7)]
    assert get(alphabet.posterior_code(F.lit(0.96))) == "*" and get(alphabet.mean_of_code(F.lit("0"))) == 0.025


def test_pairs_without_an_equal_place_stay(spark):
    aln = spark.createDataFrame([("a", 100, "ACGU"), ("a", 1, "UGCA"), ("a", 2, "ACG"), ("a", 3, "")], "aln_id string, seq_id long, row string")
    assert sorted((r.s2, r.pid) for r in columns.identities(aln).collect()) == [(1, 0.0), (2, 1.0), (3, 0.0)]
    weights = {r.seq_id: r.weight for r in columns.position_weights(aln).collect()}
    assert sum(weights.values()) == pytest.approx(4) and weights[3] == 0


def test_windows_by_share_and_last_end(spark):
    w = spark.createDataFrame([(1, 1, 10, 5.0), (1, 4, 6, 9.0), (1, 8, 30, 1.0), (1, 32, 33, 2.0)], "k long, lo long, hi long, s double")
    assert rows(intervals.merge_by_share(w, ["k"], "lo", "hi", 0.5)) == [(1, 1, 10), (1, 8, 30), (1, 32, 33)]
    assert rows(intervals.merge_by_share(w, ["k"], "lo", "hi", 0.0)) == [(1, 1, 30), (1, 32, 33)]
    assert rows(intervals.merge_survivors(w, ["k"], "lo", "hi", "s", "s").select("k", "lo", "hi", "s")) == [(1, 1, 6, 9.0), (1, 8, 30, 1.0), (1, 32, 33, 2.0)]
