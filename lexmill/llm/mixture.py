"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree.

The token budget runs down the tree.  A node shares its budget among its
children by weight; what a child cannot use within its capacity (its tokens
times the repeats allowed) goes to its siblings, and only what all of them
cannot use goes back to the level above, whose other branches take it.  Each
leaf then uses whole epochs of its documents and a token-prefix of one more
epoch, each epoch in its own seeded order.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Mapping
from functools import lru_cache
from types import MappingProxyType

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public byte-level BPE's splitting pattern (fixed value of the vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Slices of an epoch's order; a slice is summed by one task.
SLICES = 1024

@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, doc_id: str, text: str, source: str, lang: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, tokens) of every document; a NULL text has no tokens.  The vocabulary is sent to the workers."""

    docs.sparkSession.sparkContext.addFile(tokenizer)
    shipped = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(SparkFiles.get(shipped))
        for b in batches:
            b["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in b.pop("text")]
            yield b

    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    kinds = T.StructType([f for f in base.schema.fields if f.name != "text"] + [T.StructField("tokens", T.LongType())])
    return base.mapInPandas(count, kinds)


def water_fill(budget: float, weights: Mapping, capacity: Mapping) -> dict:
    """Share ``budget`` by weight under capacities; a child's shortage is shared by the others' weights."""
    given = dict.fromkeys(weights, 0.0)
    open_ = {k for k in weights if weights[k] > 0 and capacity[k] > 0}
    left = min(budget, sum(capacity[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if given[k] + left * weights[k] / total >= capacity[k]}
        if not full:
            for k in open_:
                given[k] += left * weights[k] / total
            break
        for k in full:
            left -= capacity[k] - given[k]
            given[k] = capacity[k]
        open_ -= full
    return given


def budgets(leaves: list[tuple[str, str, str, int]], targets: Mapping[str, tuple[float, int]], domains: Mapping[str, str], total: float | None) -> dict[tuple[str, str], float]:
    """Tokens for each (source, language) leaf.

    ``leaves``: (domain, language, source, tokens).  A source's weight is split
    over its languages by their tokens; the weight of a target source without
    any document stays in its domain, with its siblings.  Without ``total`` the
    budget is the largest at which every source present still gets its share.
    """
    size = {(d, lang, s): n for d, lang, s, n in leaves if n > 0 and s in targets}
    by_source: dict[str, int] = {}
    for (_, _, s), n in size.items():
        by_source[s] = by_source.get(s, 0) + n
    whole = {s: float(w) for s, (w, _) in targets.items() if w > 0}
    if not size or not whole:
        return {}
    norm = sum(whole.values())
    domain_weight: dict[str, float] = {}
    for s, w in whole.items():
        d = domains.get(s, s)
        domain_weight[d] = domain_weight.get(d, 0.0) + w / norm
    weight = {k: whole.get(k[2], 0.0) / norm * n / by_source[k[2]] for k, n in size.items()}
    capacity = {k: float(n * max(0, targets[k[2]][1])) for k, n in size.items()}
    live: dict[str, float] = {}
    for k, w in weight.items():
        live[k[0]] = live.get(k[0], 0.0) + w
    if total is None:
        kept = sum(w for d, w in domain_weight.items() if live.get(d))
        # Under this budget no leaf meets its capacity: a leaf gets budget * domain share * its part of the domain.
        total = min((capacity[k] / (domain_weight[k[0]] / kept * w / live[k[0]]) for k, w in weight.items() if w > 0 and capacity[k] > 0), default=0.0)
    level = lambda keys, i: sorted({k[i] for k in keys})
    out: dict[tuple[str, str], float] = {}
    doms = level(size, 0)
    cap_d = {d: sum(c for k, c in capacity.items() if k[0] == d) for d in doms}
    for d, for_d in water_fill(total, {d: domain_weight[d] for d in doms}, cap_d).items():
        in_d = [k for k in size if k[0] == d]
        langs = level(in_d, 1)
        w_l = {g: sum(weight[k] for k in in_d if k[1] == g) for g in langs}
        c_l = {g: sum(capacity[k] for k in in_d if k[1] == g) for g in langs}
        for g, for_g in water_fill(for_d, w_l, c_l).items():
            in_g = [k for k in in_d if k[1] == g]
            for k, n in water_fill(for_g, {k: weight[k] for k in in_g}, {k: capacity[k] for k in in_g}).items():
                out[(k[2], k[1])] = n
    return out


def _epoch_prefix(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Documents whose place in the seeded order of their leaf's last, partial epoch lies in its token-prefix.

    A leaf of any size is cut into slices of the order's hash; slice sums give
    the offsets, so no task sorts or sums a whole leaf.
    """
    key = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"), F.col("source"))
    placed = docs.join(F.broadcast(plan), ["source", "lang"]).filter("rest > 0").withColumn("h", key).withColumn("slice", F.pmod("h", F.lit(SLICES)))
    before = Window.partitionBy("source", "lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("source", "lang", "slice").agg(F.sum("tokens").alias("t")).select("source", "lang", "slice", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "lang", "slice").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = placed.join(sums, ["source", "lang", "slice"]).withColumn("end", F.col("start") + F.sum("tokens").over(inside)).withColumn("mid", F.col("end") - F.col("tokens") / 2)
    cut = materialise(cut.select("doc_id", "source", "lang", "rest", "place", "tokens", "end", "mid"), "epochs")
    ends = cut.join(F.broadcast(_carried(cut)), ["source", "lang"])
    return ends.filter(F.col("mid") <= F.col("upto")).select("doc_id", "source", F.lit(1).alias("extra"))


def _carried(cut: DataFrame) -> DataFrame:
    """(source, lang, upto): each leaf's prefix budget with what the leaves of its source before it drew too little or too much.

    What is carried is at most half the source's longest document, so only the
    documents whose middle lies that near to their leaf's budget are looked at;
    the others are summed beforehand.
    """
    reach = cut.groupBy("source").agg((F.max("tokens") / 2).alias("reach"))
    near = cut.join(reach, "source").withColumn("near", F.abs(F.col("mid") - F.col("rest")) <= F.col("reach"))
    sure = F.coalesce(F.max(F.when(~F.col("near") & (F.col("mid") < F.col("rest")), F.col("end"))), F.lit(0)).cast("double")
    leaves = near.groupBy("source", "lang").agg(F.first("place").alias("place"), F.first("rest").alias("rest"), sure.alias("end"), F.lit(float("-inf")).alias("mid"))
    steps = leaves.unionByName(near.filter("near").select("source", "lang", "place", "rest", F.col("end").cast("double").alias("end"), F.col("mid").cast("double").alias("mid")))

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        rows, over = [], 0.0
        for (_, lang), leaf in frame.groupby(["place", "lang"]):
            upto = leaf["rest"].iloc[0] + over
            over = upto - leaf.loc[leaf["mid"] <= upto, "end"].max()
            rows.append((leaf["source"].iloc[0], lang, upto))
        return pd.DataFrame(rows, columns=["source", "lang", "upto"])

    return steps.groupBy("source").applyInPandas(carry, "source string, lang string, upto double")


def mixture(
    docs: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
    total_tokens: float | None = None, seed: int = 17, domains: Mapping[str, str] = MappingProxyType({}), tokenizer: str = TOKENIZER,
) -> DataFrame:
    """(doc_id, source, tokens, uses): the documents drawn, each used at most its source's max_repeats times.

    ``targets`` holds (source, target_share, max_repeats), one row per source
    (of repeated rows the largest values count).  Documents without a source, a
    target, an id or tokens are not drawn; a NULL language is a language of its
    own.  Repeated rows of one document count once.  Without documents or
    targets nothing is drawn.  ``domains`` names the domain of a source; one not
    named is a domain of its own.  A prefix ends at the document boundary
    nearest to its budget, and the difference goes to the next leaf of its
    source, the smallest first, so a source misses its share by at most half a
    document where it has the supply.
    """
    wanted = {r["source"]: (r["w"], r["m"]) for r in targets.filter("source IS NOT NULL AND target_share IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("w"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("m")).collect()}
    counted = with_tokens(docs.filter(F.col(doc_id).isNotNull() & F.col(source).isin(list(wanted))), doc_id, text, source, lang, tokenizer)
    counted = counted.groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"), F.min("lang").alias("lang")).withColumn("lang", F.coalesce("lang", F.lit("")))
    counted = materialise(counted, "tokens").filter("tokens > 0")
    # One row per source and language: bounded by the number of targets times that of languages.
    sizes = counted.groupBy("source", "lang").agg(F.sum("tokens").alias("n")).collect()
    split = budgets([(domains.get(r["source"], r["source"]), r["lang"], r["source"], r["n"]) for r in sizes], wanted, domains, total_tokens)
    have = {(r["source"], r["lang"]): r["n"] for r in sizes}
    rows = []
    for place, (leaf, n) in enumerate(sorted(split.items(), key=lambda x: (have[x[0]], x[0]))):
        epochs = min(int(n // have[leaf]), wanted[leaf[0]][1])
        rows.append((*leaf, epochs, float(n - epochs * have[leaf]) if epochs < wanted[leaf[0]][1] else 0.0, place))
    plan = docs.sparkSession.createDataFrame(rows, "source string, lang string, epochs int, rest double, place int")
    extra = _epoch_prefix(counted, plan, seed)
    used = counted.join(F.broadcast(plan), ["source", "lang"]).join(extra, ["doc_id", "source"], "left")
    return used.withColumn("uses", F.col("epochs") + F.coalesce("extra", F.lit(0))).filter("uses > 0").select("doc_id", "source", "tokens", "uses")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, largest_uses, tokens, share) for every target source."""
    got = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("uses").alias("largest_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    every = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"))
    table = every.join(got, "source", "left").fillna(0, ["documents", "largest_uses", "tokens"])
    whole = F.sum("tokens").over(Window.partitionBy())  # as many rows as there are targets
    return table.withColumn("share", F.try_divide(F.col("tokens").cast("double"), whole))
