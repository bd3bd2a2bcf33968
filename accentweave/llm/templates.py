"""Line dedup by a log-template tree.

Method. Lines are parsed down a tree of fixed depth: number of tokens, then the leading tokens, where a
token with a digit counts as a variable field ``<*>``. Each leaf holds the lines that got there. A leaf
whose lines come from at least ``min_docs`` documents is generalised: a position where no token has the
majority of the leaf's lines becomes a field, and lines that agree with all other positions share the
leaf's template, provided that at least ``min_literal`` of its positions stay literal. As several templates may begin alike,
the same is done for the leaves that the tree would have with more leading tokens, up to ``deepest``. Every other line
is its own template, fields masked; but where less than ``min_literal`` of its tokens are literal, as in rows of
numbers, it stands for nothing but its own text, unmasked. Templates found in ``min_docs`` documents or more are dropped
wherever they occur, or everywhere but in the first document that has them.

Lines travel as hashes; their tokens are only read again for leaves that can be generalised. Counts are
summed before they are shuffled. Only DataFrame functions are used.

Edge cases. Lines are what lies between ``\\n``; blank lines have no template and are never dropped. A
null text stays null and has no lines. Rows with equal ``doc_id`` are one document for counting and
each keeps its own text; a null ``doc_id`` is a document of its own. An empty table gives an empty
result. Other columns come back unchanged; one that has a name of the added columns is replaced, and these can be named
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_name, gathered, stash

FIELD = "<*>"


def _plain(line: Column) -> Column:
    """The line's tokens joined by one space."""
    odd = line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line))


def _fields(plain: Column) -> Column:
    """Tokens with a digit become fields."""
    return F.regexp_replace(plain, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", FIELD)


def _masked(line: Column) -> Column:
    """The line's tokens joined by one space, those with a digit as fields. Most lines need neither expression."""
    return F.when(line.rlike("[0-9]"), _fields(_plain(line))).otherwise(_plain(line))


def _tokens(masked: Column) -> Column:
    return F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))) + 1


def _bare(masked: Column, min_literal: float) -> Column:
    """Whether too few of the tokens are literal for the masked line to be a template."""
    return _tokens(masked) - F.regexp_count(masked, F.lit(r"(?<![^ ])<\*>(?![^ ])")) < F.lit(min_literal) * _tokens(masked)


def _key(line: Column, min_literal: float) -> Column:
    """The hash by which a line is counted and dropped: of its own template, or of its text where that is bare."""
    plain = _plain(line)
    return F.when(line.rlike("[0-9]"), F.when(_bare(_fields(plain), min_literal), F.xxhash64(plain)).otherwise(F.xxhash64(_fields(plain)))).otherwise(F.xxhash64(plain))


def _filled(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def lines_of(docs: DataFrame, depth: int = 3, min_literal: float = 0.6) -> DataFrame:
    """``(doc_id, masked, leaf, line, text_key)``: every line that is not blank, its leaf and its own template's hash.

    ``text_key`` is the hash of the line's text if its template has too few literal tokens, and null otherwise.
    """
    raw = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).where(_filled(F.col("raw")))
    masked = raw.select("doc_id", "raw", _masked(F.col("raw")).alias("masked"))
    leaf = F.xxhash64(_tokens(F.col("masked")), F.substring_index("masked", " ", depth))
    text_key = F.when(F.col("masked").contains(FIELD) & _bare(F.col("masked"), min_literal), F.xxhash64(_plain(F.col("raw"))))
    return masked.select("doc_id", "masked", leaf.alias("leaf"), F.xxhash64("masked").alias("line"), text_key.alias("text_key"))


def _document_counts(rows: DataFrame, key: str) -> DataFrame:
    """Documents with each key, and the first of them."""
    each = rows.select(key, "doc_id").distinct()
    return each.groupBy(key).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def leaf_templates(docs: DataFrame, forms: DataFrame, depth: int, deepest: int, min_literal: float) -> DataFrame:
    """``(leaf, line)`` for the lines of ``forms(leaf, line, weight, rep)`` that take the template of a leaf they are in.

    These leaves are those with ``depth`` to ``deepest`` leading tokens. A line's tokens are read from one document that
    has it, ``rep``.
    """
    owners = forms.select("rep").distinct()
    read = lines_of(docs.join(owners, docs["doc_id"].eqNullSafe(owners["rep"]), "left_semi"), depth).alias("r")
    f = forms.alias("f")
    mine = (F.col("r.leaf") == F.col("f.leaf")) & (F.col("r.line") == F.col("f.line")) & F.col("r.doc_id").eqNullSafe(F.col("f.rep"))
    texts = f.join(read, mine).groupBy("f.leaf", "f.line").agg(F.max("f.weight").alias("weight"), F.max("r.masked").alias("masked"))
    every = F.array_distinct(F.array(*[F.xxhash64(_tokens(F.col("masked")), F.substring_index("masked", " ", d)) for d in range(depth, deepest + 1)]))
    tokens = texts.select(F.explode(every).alias("leaf"), "line", "weight", "masked").select("leaf", "line", "weight", F.posexplode(F.split("masked", " ")).alias("pos", "token"))
    votes = tokens.groupBy("leaf", "pos", "token").agg(F.sum("weight").alias("votes"))
    top = votes.groupBy("leaf", "pos").agg(F.sum("votes").alias("n"), F.max(F.struct("votes", "token")).alias("best"))
    literal = (2 * F.col("best.votes") > F.col("n")) & (F.col("best.token") != FIELD)
    fixed = top.select("leaf", "pos", F.when(literal, F.col("best.token")).alias("fixed"))
    sound = fixed.groupBy("leaf").agg(F.count("*").alias("n"), F.count("fixed").alias("literal")).where(F.col("literal") >= min_literal * F.col("n")).select("leaf", "literal")
    agreed = tokens.join(fixed.where("fixed is not null"), ["leaf", "pos"]).where("token = fixed").groupBy("leaf", "line").agg(F.count("*").alias("agreed"))
    return agreed.join(sound, "leaf").where("agreed = literal").select("leaf", "line")


def recurring(docs: DataFrame, keys: DataFrame, min_docs: int, depth: int, deepest: int, min_literal: float) -> DataFrame:
    """``(line, first_doc)``: the key of every line whose template recurs, and the first document with it.

    ``keys(doc_id, leaf, line, text_key)`` are the lines of ``docs``, stashed. Bare lines vote in their leaf, but as no
    template agrees with them, only their texts recur.
    """
    kinds = keys.groupBy("leaf", "line").agg(F.count("*").alias("weight"), F.min("doc_id").alias("rep"))
    many = kinds.groupBy("leaf").agg(F.count("*").alias("n_lines"), F.sum("weight").alias("n")).where((F.col("n_lines") > 1) & (F.col("n") >= min_docs)).select("leaf")
    wide = _document_counts(keys, "leaf").where(F.col("n_docs") >= min_docs).select("leaf").join(many, "leaf")
    forms, _ = stash(gathered(kinds.join(wide, "leaf")), "line-forms")
    general, _ = stash(gathered(leaf_templates(docs, forms, depth, deepest, min_literal)), "line-leaves")
    own = _document_counts(keys.select("doc_id", F.coalesce("text_key", "line").alias("line")), "line").where(F.col("n_docs") >= min_docs).select("line", "first_doc")
    leaves = _document_counts(keys.select("doc_id", "line").join(general, "line"), "leaf").where(F.col("n_docs") >= min_docs).select("leaf", "first_doc")
    by_leaf = general.join(leaves, "leaf").select("line", "first_doc")
    return own.unionByName(by_leaf).groupBy("line").agg(F.min("first_doc").alias("first_doc"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, depth: int = 3, deepest: int = 5, min_literal: float = 0.6, keep_first: bool = False, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with recurring lines gone from ``text``, and the numbers of lines and of dropped lines added as ``names``.

    Lines that are blank are not counted. With ``keep_first`` the smallest ``doc_id`` that has a template keeps its lines.
    A document's recurring keys are dealt to as many buckets as the root of their number, so that a line is looked for
    in one bucket and not in all keys of a long document.
    """
    keys, _ = stash(lines_of(docs, depth, min_literal).select("doc_id", "leaf", "line", "text_key"), "line-keys")
    gone = keys.select("doc_id", F.coalesce("text_key", "line").alias("line")).join(recurring(docs, keys, min_docs, depth, deepest, min_literal), "line")
    if keep_first:
        gone = gone.where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    sets = gone.groupBy("doc_id").agg(F.collect_set("line").alias("every")).withColumn("n", F.ceil(F.sqrt(F.size("every"))).cast("int"))
    lost, kept_lines, key = (free_name(docs, n) for n in ("lost", "kept_lines", "lost_key"))
    sets = sets.select(F.col("doc_id").alias(key), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda b: F.filter("every", lambda k: F.pmod(k, F.col("n")) == b)).alias(lost))
    joined = docs.join(sets, docs["doc_id"].eqNullSafe(sets[key]), "left").drop(key)
    parts = F.split("text", "\n")

    def stays(raw: Column) -> Column:
        at = F.transform(F.array(_key(raw, min_literal)), lambda k: F.array_contains(F.get(lost, F.pmod(k, F.size(lost)).cast("int")), k))
        return ~at[0]

    out = joined.withColumn(kept_lines, F.when(F.col(lost).isNotNull(), F.filter(parts, stays)).otherwise(parts))
    filled = lambda column: F.coalesce(F.size(F.filter(column, _filled)), F.lit(0)).cast("long")
    counted = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(filled(parts))
    dropped = F.when(F.col(lost).isNull(), F.lit(0).cast("long")).otherwise(counted - filled(F.col(kept_lines)))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n"))
    own = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in names]
    return out.select(*own, counted.alias(names[0]), dropped.alias(names[1]))
