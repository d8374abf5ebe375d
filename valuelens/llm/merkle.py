"""Merkle manifest of a table: a tree of three for each source, and one over the sources' roots.

A level is computed by fixed-offset lags and leads: row i of a group carries its node, the
siblings stand 1 and 2 nodes before and behind, masked by the node's slot in its run of
three and by where the run ends, and the row of the first child hashes the parent. Rows
are numbered in their group by a range sort, so blocks of BLOCK = 3 ** LEVELS rows begin at
whole runs of all LEVELS levels: windows are partitioned by group and block, one shuffle
serves LEVELS levels, and no group has to fit in a task. The blocks' tops are the rows of
the next pass. Proofs come down again: a block's rows share the path above their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table
from .order import placed

RUN, LEVELS = 3, 5
BLOCK = RUN ** LEVELS
_PATH = "array<struct<before:string,after:string>>"


def field(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def levels(n: Column) -> Column:
    """Levels until ``n`` nodes are one, LEVELS at most."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(n <= RUN ** k, F.lit(k)).otherwise(out)
    return out


def climb(nodes: DataFrame) -> DataFrame:
    """``nodes`` (grp, i, n, digest and others) with ``path``, the siblings' digests of up to LEVELS levels, and ``top``, at a block's first row the block's node above."""
    rows = nodes.withColumn("block", F.floor(F.col("i") / BLOCK)).withColumn("steps", levels(F.col("n"))).withColumn("top", F.col("digest"))
    window = Window.partitionBy("grp", "block").orderBy("i")
    for k in range(LEVELS):
        stride = RUN ** k
        slot, lives = F.floor(F.col("i") / stride) % RUN, F.col("steps") > k
        beside = {o: (F.lag if o < 0 else F.lead)("top", abs(o) * stride).over(window) for o in (-2, -1, 1, 2)}
        before = F.concat_ws("", F.when(slot == 2, beside[-2]), F.when(slot >= 1, beside[-1]))
        after = F.concat_ws("", F.when(slot <= 1, beside[1]), F.when(slot == 0, beside[2]))
        rows = rows.withColumn(f"_{k}", F.when(lives & (F.col("i") % stride == 0), F.struct(before.alias("before"), after.alias("after"))))
        parent = F.when(lives, digest(F.col("top"), F.col(f"_{k}.after"))).otherwise(F.col("top"))
        rows = rows.withColumn("top", F.when(F.col("i") % (stride * RUN) == 0, parent))
    # a row's node of level k is that of the last row before it which has one
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    path = F.filter(F.array(*[F.last(f"_{k}", ignorenulls=True).over(upto) for k in range(LEVELS)]), lambda x: x.isNotNull())
    return rows.withColumn("path", path).drop("steps", *[f"_{k}" for k in range(LEVELS)])


class Towers:
    """The passes over a forest of ``nodes`` (grp, i, n, digest and others), from the leaves to the groups' roots."""

    def __init__(self, nodes: DataFrame, label: str):
        self.passes = []
        while True:
            self.passes.append(stage(climb(nodes), label))
            tops = self.passes[-1].where((F.col("i") % BLOCK == 0) & (F.col("n") > BLOCK))
            if tops.isEmpty():
                break
            nodes = tops.select("grp", "block", "n", "top").select("grp", F.col("block").alias("i"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))

    def roots(self) -> DataFrame:
        """grp, root."""
        out = None
        for p in self.passes:
            done = p.where(f"i = 0 AND n <= {BLOCK}").select("grp", F.col("top").alias("root"))
            out = done if out is None else out.unionByName(done)
        return out

    def paths(self, above: DataFrame) -> DataFrame:
        """The leaves with ``path`` up to the top and the other columns of ``above``, which has grp, path and others of each group's root.

        Rows meet what is above them by group and block, so a key has BLOCK rows at most.
        """
        more = [c for c in above.columns if c not in ("grp", "path")]
        over = None
        for p in reversed(self.passes):
            ends = p.where(f"i = 0 AND n <= {BLOCK}").select("grp", F.lit(0).cast("long").alias("block")).join(above, "grp")
            over = ends if over is None else over.unionByName(ends)
            own = [c for c in p.columns if c not in ("path", "top", "block", "digest")]
            joined = p.join(over.withColumnRenamed("path", "_above"), ["grp", "block"])
            full = joined.select(*own, "digest", F.concat("path", "_above").alias("path"), *more)
            over = full.select("grp", F.col("i").alias("block"), "path", *more)
        return full


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def proof(path: Column) -> Column:
    """Digest of the siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(rows: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """key, leaf, altered, subroot, root and path of every row of ``rows`` (key, source, leaf and altered, hex digests).

    Leaves of a source ascend by key (null first), those of one key by leaf; rows that
    are alike in all columns are leaves of their own. Sources ascend, null first; a lone
    leaf is its subroot, a lone subroot the root. ``path`` has the siblings before and
    behind each node up to the root. An empty table gives an empty manifest.
    """
    grp = F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source).cast("string")))
    leaves = stage(rows.select(F.col(key).alias("id"), grp.alias("grp"), F.col("leaf").alias("digest"), "altered", F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    nodes = placed(leaves, "grp", ["id", "digest", "row"], "merkle-order").select("grp", F.col("before").alias("i"), F.col("total").alias("n"), "digest", "altered", "id")
    trees = Towers(nodes, "merkle-tower")
    subroots = stage(trees.roots().select(F.lit("").alias("all"), F.col("grp").alias("src"), "root"), "merkle-subroots")
    heads = placed(subroots, "all", ["src"], "merkle-sources").select(F.col("all").alias("grp"), F.col("before").alias("i"), F.col("total").alias("n"), F.col("root").alias("digest"), "src")
    crown = Towers(heads, "merkle-crown")
    top = crown.roots().first()
    above = crown.paths(heads.sparkSession.createDataFrame([("", [])], f"grp string, path {_PATH}"))
    above = stage(above.select(F.col("src").alias("grp"), "path", F.col("digest").alias("subroot")), "merkle-above")
    return trees.paths(above).select(F.col("id").alias(key), F.col("digest").alias("leaf"), "altered", "subroot", F.lit(top["root"] if top else None).cast("string").alias("root"), "path")


def op12_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether a copy that lost line breaks still folds to the root.

    The copies of documents whose doc_id has an even crc32 lose all line breaks of their
    text; a document without doc_id keeps them.
    """
    docs = table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = lambda text: digest(*map(field, [*rest, text]))
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    rows = docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"),
                       F.when(hit, leaf(F.translate("text", "\n", ""))).alias("altered"))
    out = manifest(rows)
    out = out.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(height: int = 12) -> str:
    """The same by joins, for up to 3 ** ``height`` documents a source and as many sources."""
    def enc(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # crc32 by its bits: the text is at most 20 digits
    ctes = [f"""crc AS (SELECT d AS doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(str_split(d::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS c
  FROM (SELECT DISTINCT doc_id AS d FROM documents WHERE doc_id IS NOT NULL))""",
            f"""base AS (SELECT d.*, {leaf('text')} AS leaf,
  CASE WHEN xor(c, 4294967295) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS altered FROM documents d LEFT JOIN crc USING (doc_id))""",
            "grp AS (SELECT *, row_number() OVER () AS rid, coalesce('1' || source, '0') AS g FROM base)",
            "a0 AS (SELECT g, rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS h FROM grp)"]

    def tree(p: str) -> None:
        for k in range(height):  # a tree of one node stays as it is
            ctes.append(f"{p}{k + 1} AS (SELECT g, i // 3 AS i, (any_value(n) + 2) // 3 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {p}{k} GROUP BY g, i // 3)")
            side = "coalesce((SELECT string_agg(s.h, '' ORDER BY s.i) FROM {p}{k} s WHERE s.g = x.g AND s.n > 1 AND s.i // 3 = x.i // 3 AND s.i {c} x.i), '')"
            ctes.append(f"{p}s{k} AS (SELECT g, i, n, {side.format(p=p, k=k, c='<')} AS l, {side.format(p=p, k=k, c='>')} AS r FROM {p}{k} x)")

    tree("a")
    ctes.append(f"b0 AS (SELECT 'x' AS g, g AS src, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM a{height})")
    tree("b")
    ctes.append("p0 AS (SELECT grp.rid, grp.g, grp.doc_id, leaf, altered, a0.i, altered AS f, '' AS p FROM grp JOIN a0 USING (rid))")
    last, n = "p0", 0

    def fold(p: str, g: str) -> None:
        nonlocal last, n
        for k in range(height):
            n += 1
            ctes.append(f"p{n} AS MATERIALIZED (SELECT x.* REPLACE (x.i // 3 AS i, CASE WHEN s.n > 1 THEN sha256(l || f || r) ELSE f END AS f, p || l || r AS p) FROM {last} x JOIN {p}s{k} s ON s.g = {g} AND s.i = x.i)")
            last = f"p{n}"

    fold("a", "x.g")
    n += 1
    ctes.append(f"p{n} AS (SELECT x.* REPLACE (b0.i AS i), b0.h AS subroot FROM {last} x JOIN b0 ON b0.src = x.g)")
    last = f"p{n}"
    fold("b", "'x'")
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, (SELECT h FROM b{height}) AS root, sha256(p) AS proof_sha256, f AS folded_root, "
            f"f = (SELECT h FROM b{height}) AS verified FROM {last}")


QUERIES = {"op12_lag_lead": op12_lag_lead}
SQL = {"op12_lag_lead": _sql()}
