"""States, connections and sizes of tree-shaped models, from their lists of nodes; and what is folded along a sequence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The states of each kind of node in their order; those before the inserts are entered from the node above.
STATES = {
    "ROOT": ["S", "IL", "IR"], "MATP": ["MP", "ML", "MR", "D", "IL", "IR"], "MATL": ["ML", "D", "IL"], "MATR": ["MR", "D", "IR"], "BIF": ["B"], "BEGL": ["S"], "BEGR": ["S", "IL"], "END": ["E"],
}
#: Residues that a state emits to its left and right.
EMITS = {"MP": (1, 1), "ML": (1, 0), "IL": (1, 0), "MR": (0, 1), "IR": (0, 1), "D": (0, 0), "S": (0, 0), "B": (0, 0), "E": (0, 0), "EL": (0, 0)}
#: Consensus columns of a node.
COLUMNS = {"MATP": 2, "MATL": 1, "MATR": 1}


def _map(values: dict) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))))


def emits(state: Column) -> tuple[Column, Column, Column]:
    """Residues that a state emits: in all, left, right."""
    left, right = _map({k: v[0] for k, v in EMITS.items()}), _map({k: v[1] for k, v in EMITS.items()})
    return F.element_at(left, state) + F.element_at(right, state), F.element_at(left, state), F.element_at(right, state)


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes (model, nd, node, and parent if models may split), each with its kinds of states, the numbers of its inserts and of its other states, its first
    state's number, the number of states that the next node is entered by, what stands before and after it, and of a split and its right part both first states."""
    kinds = F.element_at(_map({k: F.array(*map(F.lit, v)) for k, v in STATES.items()}), F.col("node"))
    inserts = F.element_at(_map({k: sum(s in ("IL", "IR") for s in v) for k, v in STATES.items()}), F.col("node"))
    entered = F.element_at(_map({k: sum(s not in ("IL", "IR") for s in v) for k, v in STATES.items()}), F.col("node"))
    order = Window.partitionBy("model").orderBy("nd")
    sized = nodes.withColumns({"kinds": kinds, "inserts": inserts, "entered": entered})
    found = sized.withColumns({
        "first": F.coalesce(F.sum(F.size("kinds")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"), "next": F.coalesce(F.lead("entered").over(order), F.lit(0)),
        "before": F.coalesce(F.lag(F.size("kinds")).over(order), F.lit(0)), "following": F.lead("node").over(order),
    })
    if "parent" not in nodes.columns:
        return found.withColumns({"split": F.lit(None).cast("int"), "right": F.lit(None).cast("int")})
    # A split and its right part meet by the split's number, where every other node is alone; models stay where they are.
    pair = Window.partitionBy("model", F.when(F.col("node") == "BEGR", F.col("parent")).otherwise(F.col("nd")))
    of = lambda kind: F.max(F.when(F.col("node") == kind, F.col("first"))).over(pair)
    return found.withColumns({"split": of("BIF"), "right": of("BEGR")})


def linked(nodes: DataFrame, *keep: str) -> DataFrame:
    """(model, v, nd, node, state, insert, cfirst, cnum, plast, pnum) of all states of models, by their nodes, with other columns to keep.

    A state's children are the inserts of its node that it may go on to, itself among them if it is one, and the states by
    which the next node is entered; they have consecutive numbers. A split's first child is its left part's start, and its `cnum`
    is the number of its right part's start, as the file format has it. plast and pnum are the last of the states that lead to a
    state, and how many do (-1 and 0 for none). All of it follows from a node's own place, without a join.
    """
    columns = ["model", "nd", "node", "first", "inserts", "entered", "next", "before", "split", "right", *keep]
    each = placed(nodes).select(*columns, F.posexplode("kinds").alias("i", "state"))
    insert, v = F.col("i") >= F.col("entered"), F.col("first") + F.col("i")
    first = F.when(F.col("state") == "E", F.lit(-1)).when(insert, v).otherwise(F.col("first") + F.col("entered"))
    number = F.when(insert, F.col("entered") + F.col("inserts") - F.col("i")).otherwise(F.col("inserts")) + F.col("next")
    number = F.when(F.col("state") == "E", 0).when(F.col("node") == "BIF", F.coalesce("right", number)).otherwise(number)
    # An insert is led to by its node's states up to itself, others by all states of the node above, a right part by its split.
    right = F.col("node") == "BEGR"
    plast = F.when(insert, v).when(right, F.col("split")).when(F.col("before") > 0, F.col("first") - 1)
    pnum = F.when(insert, F.col("i") + 1).when(right, F.col("split").isNotNull().cast("int")).otherwise(F.col("before"))
    return each.select(
        "model", v.cast("int").alias("v"), "nd", "node", "state", insert.alias("insert"), first.cast("int").alias("cfirst"), number.cast("int").alias("cnum"), F.coalesce(plast, F.lit(-1)).cast("int").alias("plast"), pnum.cast("long").alias("pnum"), *keep
    )


def states(nodes: DataFrame) -> DataFrame:
    """(model, v, nd, node, state, insert, cfirst, cnum) of all states of models."""
    return linked(nodes).drop("plast", "pnum")


def parents(of: DataFrame) -> DataFrame:
    """(model, v, plast, pnum): the last of the states that lead to a state, and how many do; -1 and 0 for none."""
    edges = of.filter("cnum > 0").select("model", F.col("v").alias("parent"), F.explode(F.sequence(F.col("cfirst"), F.col("cfirst") + F.col("cnum") - 1)).alias("v"))
    found = edges.groupBy("model", "v").agg(F.max("parent").alias("plast"), F.count("*").alias("pnum"))
    return of.select("model", "v").join(found, ["model", "v"], "left").select("model", "v", F.coalesce("plast", F.lit(-1)).alias("plast"), F.coalesce("pnum", F.lit(0)).alias("pnum"))


def summary(nodes: DataFrame) -> DataFrame:
    """(model, nodes, states, clen, pairs, bifurcations) of each model."""
    columns = F.coalesce(F.element_at(_map(COLUMNS), F.col("node")), F.lit(0))
    number = F.element_at(_map({k: len(v) for k, v in STATES.items()}), F.col("node"))
    count = lambda kind: F.sum((F.col("node") == kind).cast("long"))
    return nodes.groupBy("model").agg(F.count("*").alias("nodes"), F.sum(number).alias("states"), F.sum(columns).alias("clen"), count("MATP").alias("pairs"), count("BIF").alias("bifurcations"))


def emit_map(nodes: DataFrame) -> DataFrame:
    """(model, nd, node, lpos, rpos): the consensus positions that each node of a model without bifurcations covers, from the
    left one it emits or has emitted to its left, to the right one it emits or the one before what was emitted to its right."""
    order = Window.partitionBy("model").orderBy("nd")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left, right = F.col("node").isin("MATP", "MATL").cast("long"), F.col("node").isin("MATP", "MATR").cast("long")
    clen = F.sum(left + right).over(Window.partitionBy("model"))
    lpos = F.coalesce(F.sum(left).over(before), F.lit(0)) + left
    rpos = clen + 1 - F.coalesce(F.sum(right).over(before), F.lit(0)) - right
    return nodes.select("model", "nd", "node", lpos.alias("lpos"), rpos.alias("rpos"))


def begin_share(internal: float) -> Column:
    """How likely a node is the one that is entered: the first one, unless one of the later nodes that match or split is, all of them alike."""
    starts = F.col("node").isin("MATP", "MATL", "MATR", "BIF") & (F.col("nd") > 1)
    many = F.sum(starts.cast("long")).over(Window.partitionBy("model"))
    return F.when(F.col("nd") == 1, 1 - internal).when(starts, internal / many).otherwise(0.0)


def local_begins(nodes: DataFrame, internal: float) -> DataFrame:
    """(model, nd, p) of the nodes that may be entered."""
    return nodes.withColumn("p", begin_share(internal)).filter("p > 0").select("model", "nd", "p")


def matrix_megabytes(bands: DataFrame, bytes_per_cell: int = 4) -> DataFrame:
    """(model, cells, mb) of the matrices that bands (model, dmin, dmax) of all states need."""
    cells = F.sum(F.greatest(F.lit(0), F.col("dmax") - F.col("dmin") + 1))
    return bands.groupBy("model").agg(cells.alias("cells"), (cells * bytes_per_cell / 1e6).alias("mb"))


def base_pairs(structure: Column) -> Column:
    """array<struct<i, j>> of the base pairs of a structure in bracket notation, in order of j; null if it is not well formed.

    All four brackets share one stack and must match in kind; each letter from A to Z has one of its own, closed by its small
    letter. The fold keeps the open places of all stacks as one array, so a text costs its length times its depth.
    """
    kinds = {"<": ">", "(": ")", "[": "]", "{": "}"} | {chr(65 + k): chr(97 + k) for k in range(26)}
    opens, closes = _map(kinds), _map({v: k for k, v in kinds.items()})
    pair, shape = "struct<i:int,j:int>", "struct<open:array<struct<at:int,c:string>>,pairs:array<struct<i:int,j:int>>,ok:boolean>"
    nothing = F.struct(F.array().alias("open"), F.array().alias("pairs"), F.lit(True).alias("ok")).cast(shape)
    bracket = lambda c: c.isin(*"<([{")

    def step(s: Column, x: Column) -> Column:
        c, at = x["c"], x["at"]
        pushed = F.struct(F.concat(F.array(F.struct(at.alias("at"), c.alias("c"))), s["open"]).alias("open"), s["pairs"].alias("pairs"), s["ok"].alias("ok")).cast(shape)
        wanted = F.element_at(closes, c)
        mine = lambda o: F.when(bracket(wanted), bracket(o["c"])).otherwise(o["c"] == wanted)
        top = F.get(F.filter(s["open"], mine), F.lit(0))
        found = F.struct(top["at"].alias("i"), at.alias("j")).cast(pair)
        rest = F.filter(s["open"], lambda o: o["at"] != top["at"])
        popped = F.struct(F.coalesce(rest, F.array().cast("array<struct<at:int,c:string>>")).alias("open"), F.concat(s["pairs"], F.array(found)).alias("pairs"), (s["ok"] & F.coalesce(top["c"] == wanted, F.lit(False))).alias("ok")).cast(shape)
        passed = F.struct(s["open"].alias("open"), s["pairs"].alias("pairs"), (s["ok"] & c.isin(*":,_-.~")).alias("ok")).cast(shape)
        return F.when(F.map_contains_key(opens, c), pushed).when(F.map_contains_key(closes, c), popped).otherwise(passed)

    letters = F.transform(F.filter(F.split(structure, ""), lambda c: c != ""), lambda c, i: F.struct((i + 1).alias("at"), c.alias("c")))
    return F.aggregate(letters, nothing, step, lambda s: F.when(s["ok"] & (F.size(s["open"]) == 0), s["pairs"]))


def bias_score(text: str, stay: float, enter: float, odds: list[dict[str, float]]) -> float:
    """Natural log score of a sequence under a null model of two states (plain and biased), less that of its length alone.

    odds are what each state emits over the background; others than the four residues have odds 1. The steps from place to place are
    multiplied in pairs, pairs of pairs and so on, each scaled.
    """
    n = float(len(text))
    p1 = n / (n + 1.0)
    symbols = sorted({x for o in odds for x in o})
    place = np.full(256, len(symbols))
    place[[ord(x) for x in symbols]] = range(len(symbols))
    codes = place[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
    plain, biased = (np.array([float(o.get(x, 1.0)) for x in symbols] + [1.0]) for o in odds)
    v = np.array([(1.0 - enter) * plain[codes[0]], enter * biased[codes[0]]])
    # What goes from plain to plain, to biased, and from biased to plain, to biased.
    m, log = np.stack([p1 * plain, (1 - p1) * biased, (1 - stay) * plain, stay * biased])[:, codes[1:]], 0.0
    while m.shape[1] > 1:
        if m.shape[1] % 2:
            m = np.hstack([m, [[1.0], [0.0], [0.0], [1.0]]])
        a, b = m[:, ::2], m[:, 1::2]
        m = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
        top = m.max(0)
        m /= top
        log += np.log(top).sum()
    if m.shape[1]:
        v = np.array([v[0] * m[0, 0] + v[1] * m[2, 0], v[0] * m[1, 0] + v[1] * m[3, 0]])
    return float(log + np.log(v.sum()) + n * np.log(p1) + np.log(1.0 - p1))


def bias_scores(seqs: DataFrame, stay: float, enter: float, odds: list[dict[str, float]]) -> DataFrame:
    """seq_id, score of sequences (seq_id, seq) that are not empty."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [bias_score(batch["seq"][k].as_py(), stay, enter, odds) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch["seq_id"], pa.array(scores, pa.float64())], names=["seq_id", "score"])

    return seqs.filter("seq <> ''").select("seq_id", "seq").mapInArrow(scored, f"seq_id {seqs.schema['seq_id'].dataType.simpleString()}, score double")


def random_stream(seed: Column, n: int, modulus: int = 4294967296, factor: int = 69069) -> Column:
    """The first n numbers of the multiplicative generator that seeds the reference stream: each is factor times the one before, below the modulus."""
    grown = F.aggregate(F.sequence(F.lit(2), F.lit(n)), F.array(seed.cast("long")), lambda a, _: F.concat(a, F.array(F.element_at(a, -1) * factor % modulus)))
    return grown


def model_headers(records: DataFrame, record: str = "record") -> DataFrame:
    """(name, acc, clen, states, nodes) of model files' records, each up to its closing line; unknown keys are ignored."""
    value = lambda key, kind: F.regexp_extract(record, rf"(?m)^{key}[ \t]+(\S+)", 1).try_cast(kind)
    told = records.filter(F.col(record).rlike("(?m)^NAME[ \t]"))
    return told.select(value("NAME", "string").alias("name"), F.nullif(value("ACC", "string"), F.lit("")).alias("acc"), value("CLEN", "int").alias("clen"), value("STATES", "int").alias("states"), value("NODES", "int").alias("nodes"))
