"""Document fingerprints as Merkle trees.

A text is cut into sections at blank lines, sections into paragraphs at line
breaks, paragraphs into pieces at sentence ends (a piece without an end has
at most 256 code points).  A node's digest is the SHA-256 of its children's
digests, so equal roots mean equal texts, and walking down the branches
that differ finds the edited pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armscope.llm.common import free_name, free_prefix, stored

#: Pieces of a paragraph; Java and RE2 read it alike, and no character is lost.
PIECES = r"[^.!?|]{1,256}[.!?|]*|[.!?|]+"
#: Hex digits of a digest that a fingerprint holds for every piece.
DIGITS = 12
#: Rows of a range of neighbours.
RANGE_ROWS = 4096


def _sha(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def leaves(text: Column) -> Column:
    """Sections, paragraphs, pieces: array<array<array<string>>> of piece digests (SHA-256 hex)."""

    def paragraph(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p, F.lit(PIECES), F.lit(0)), _sha)

    def section(s: Column) -> Column:
        return F.transform(F.split(s, "\n", -1), paragraph)

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), section)


def paragraph_digests(tree: Column) -> Column:
    """Digest of every paragraph, by section."""
    return F.transform(tree, lambda s: F.transform(s, lambda p: _sha(F.array_join(p, ""))))


def section_digests(tree: Column) -> Column:
    return F.transform(paragraph_digests(tree), lambda s: _sha(F.array_join(s, "")))


def root(tree: Column) -> Column:
    """Digest of the whole text; a null text is the empty text."""
    return _sha(F.array_join(section_digests(tree), ""))


def serialise(tree: Column) -> Column:
    """Fingerprint as text: the root, then the short digests of all pieces.

    Sections are parted by "/", paragraphs by ";", pieces by ",".
    """
    short = F.transform(
        tree,
        lambda s: F.array_join(
            F.transform(s, lambda p: F.array_join(F.transform(p, lambda x: F.substring(x, 1, DIGITS)), ",")), ";"
        ),
    )
    return F.concat(root(tree), F.lit("/"), F.array_join(short, "/"))


def _pieces(print_: Column) -> Column:
    """Distinct piece digests of a fingerprint."""
    body = F.substring(print_, 66, 2**31 - 1)
    return F.array_distinct(F.filter(F.split(body, "[/;,]"), lambda x: x != ""))


def with_likeness(pairs: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``pairs`` plus a column per entry: how alike two fingerprint columns are, 0 to 1.

    Twice the shared pieces over both sides' pieces.  Equal roots give 1.0 (also two
    empty texts), an empty text and another 0.0; a null fingerprint gives null.
    Every fingerprint is read once, into a column of its own.
    """
    x = free_prefix(pairs)
    prints = sorted({c for both in wanted.values() for c in both})
    read = pairs.select("*", *[_pieces(F.col(c)).alias(f"{x}{c}") for c in prints])
    shared = [F.size(F.array_intersect(f"{x}{a}", f"{x}{b}")).alias(f"{x}_{out}") for out, (a, b) in wanted.items()]
    sizes = [F.size(f"{x}{c}").alias(f"{x}{c}") for c in prints]
    counted = read.select(*pairs.columns, *sizes, *shared)

    def near(out: str, a: str, b: str) -> Column:
        both = F.col(f"{x}{a}") + F.col(f"{x}{b}")
        same = F.substring(F.col(a), 1, 64) == F.substring(F.col(b), 1, 64)
        return F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(None).cast("double")).when(same, 1.0).when(
            both == 0, 0.0
        ).otherwise((2 * F.col(f"{x}_{out}")).cast("double") / both)

    return counted.select(
        *[c for c in pairs.columns if c not in wanted], *[near(out, a, b).alias(out) for out, (a, b) in wanted.items()]
    )


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` plus the fingerprint of ``text``; a column named ``out`` is replaced.

    Every row on its own: nulls are empty texts, repeated rows get equal
    fingerprints, an empty table gives no rows.
    """
    tree = free_name(docs, "_tree")
    return docs.withColumn(tree, leaves(F.col(text))).withColumn(out, serialise(F.col(tree))).drop(tree)


def differing_branches(pairs: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(key, section, paragraph, piece) of every piece of fingerprint ``b`` that ``a`` lacks.

    Positions count from 0.  Pairs with equal roots are passed over unread, and
    paragraphs that occur in ``a`` as they are are not opened.
    """
    changed = pairs.filter(F.substring(a, 1, 64) != F.substring(b, 1, 64)).select(
        key, F.array_distinct(F.split(F.substring(F.col(a), 66, 2**31 - 1), "[/;]")).alias("_old"),
        _pieces(F.col(a)).alias("_known"),
        F.posexplode(F.split(F.substring(F.col(b), 66, 2**31 - 1), "/", -1)).alias("section", "_s"),
    )
    paragraphs = changed.select(
        key, "_old", "_known", "section", F.posexplode(F.split("_s", ";", -1)).alias("paragraph", "_p")
    ).filter(~F.array_contains("_old", F.col("_p")))
    return (
        paragraphs.select(key, "_known", "section", "paragraph", F.posexplode(F.split("_p", ",", -1)).alias("piece", "_x"))
        .filter((F.col("_x") != "") & ~F.array_contains("_known", F.col("_x")))
        .select(key, "section", "paragraph", "piece")
    )


def _ranges(ids: DataFrame, rows: int) -> DataFrame:
    """(coarse, fine bounds): keys at which ranges of about ``rows`` keys begin, by quantiles in two levels.

    Both levels have as many bounds as the root of the number of ranges, so the
    table grows with the rows and no list exceeds that root.
    """
    n = ids.filter("k IS NOT NULL").count()
    level = max(1, math.ceil(math.sqrt(n / rows)))
    shares = [i / level for i in range(1, level)]
    if not shares:
        return ids.sparkSession.createDataFrame([(0, None, [])], "c bigint, upper array<bigint>, fine array<bigint>")
    upper = ids.agg(F.percentile_approx("k", shares, 100 * level).alias("u")).first()["u"]
    coarse = _position(F.col("k"), F.array(*[F.lit(x) for x in upper]))
    fine = ids.filter("k IS NOT NULL").groupBy(coarse.alias("c")).agg(F.percentile_approx("k", shares, 100 * level).alias("fine"))
    return fine.select("c", F.array(*[F.lit(x) for x in upper]).alias("upper"), "fine")


def _position(key: Column, bounds: Column) -> Column:
    """How many bounds a key has reached; a null key none."""
    return F.size(F.filter(bounds, lambda x: x <= key)).cast("bigint")


def with_next(docs: DataFrame, key: str, carried: list[str], rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` plus next_<c> of the row with the next larger ``key`` (a bigint); the last row gets the first.

    Keys are cut into ranges of about ``rows`` keys by quantiles, so ids may be hashed,
    clustered or far apart.  The first row of every range is also sent to the range
    before, behind its last row, so one shuffle by range serves all rows.  Rows
    with a null or a repeated key are ordered by the carried columns; nulls come
    first.  Rows of one key stay in one range.
    """
    x = free_prefix(docs)
    ids = docs.select(F.col(key).cast("bigint").alias("k"))
    # Written first: Spark then knows that these tables are small, and the texts are not shuffled for the joins.
    bounds = stored(_ranges(ids, rows), "bounds")
    first = bounds.select("upper").first()
    upper = F.array(*[F.lit(v) for v in (first["upper"] or [])]).cast("array<bigint>") if first else F.array().cast("array<bigint>")
    fine = bounds.select(F.col("c").alias(f"{x}c"), F.col("fine").alias(f"{x}fine"))

    def ranged(frame: DataFrame, k: Column) -> DataFrame:
        """``frame`` with the number of its range, as a pair of bounds reached."""
        out = frame.withColumn(f"{x}c", F.when(k.isNull(), 0).otherwise(_position(k, upper))).join(fine, f"{x}c", "left")
        at = F.when(k.isNull(), 0).otherwise(F.coalesce(_position(k, F.col(f"{x}fine")), F.lit(0)))
        return out.withColumn(f"{x}b", F.col(f"{x}c") * F.lit(1 << 31) + at).drop(f"{x}c", f"{x}fine")

    heads = ranged(ids, F.col("k")).groupBy(F.col(f"{x}b").alias("b")).agg(
        F.min(F.struct(F.col("k").isNotNull().alias("set"), "k")).alias("head")
    )
    heads = stored(heads, "heads")
    last = heads.agg(F.max("b")).first()[0]
    if last is None:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    # One row of three numbers for each range.
    heads = stored(heads.select(
        F.col("b").alias(f"{x}b"), F.col("head.k").alias(f"{x}head"),
        F.coalesce(F.lag("b").over(Window.orderBy("b")), F.lit(last)).alias(f"{x}before"),
    ), "heads")
    placed = ranged(docs, F.col(key).cast("bigint")).join(heads, f"{x}b")
    own = F.struct(F.col(f"{x}b").alias("b"), F.lit(0).alias("extra"))
    behind = F.struct(F.col(f"{x}before").alias("b"), F.lit(1).alias("extra"))
    spots = F.when(F.col(key).eqNullSafe(F.col(f"{x}head")), F.array(own, behind)).otherwise(F.array(own))
    spot = f"{x}spot"
    placed = placed.withColumn(spot, F.explode(spots))
    order = Window.partitionBy(f"{spot}.b").orderBy(f"{spot}.extra", key, *carried)
    following = [F.lead(c).over(order).alias(f"next_{c}") for c in carried]
    return placed.select(*docs.columns, spot, *following).filter(f"{spot}.extra = 0").drop(spot)


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n/2) code points replaced by the first as many of ``following``."""
    n = F.length(text)
    cut = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def neighbour_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit by the next document, and how alike they are.

    Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.  Null texts count as empty; a table of one row is
    its own neighbour; other columns are ignored.
    """
    base = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pairs = with_next(base, key, ["text"])
    made = pairs.withColumn("edit", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    for source, out in (("text", "fingerprint"), ("edit", "edited_fingerprint"), ("next_text", "next_fingerprint")):
        made = with_fingerprint(made, source, out)
    made = made.select(
        key, F.length("text").cast("bigint").alias("n_chars"), _sha(F.col("edit")).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "next_fingerprint",
    )
    near = {"near_edited": ("fingerprint", "edited_fingerprint"), "near_next": ("fingerprint", "next_fingerprint")}
    return with_likeness(made, near).drop("next_fingerprint")
