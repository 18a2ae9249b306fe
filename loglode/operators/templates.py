"""Template mining: masked patterns by aggregation, then a small merge of distinct patterns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import line as L
from ..graph import connected
from ..schema import PreprocessRule
from ..scratch import written

LEVELS = {4: "FATAL", 3: "ERROR", 2: "WARN", 1: "INFO"}


def head_per_file(lines: DataFrame, n: int | None = None) -> DataFrame:
    """The first n lines of each file; all lines by default."""
    return lines if n is None else lines.where(F.col("line_no") <= n)


def masked_patterns(lines: DataFrame, rules: Sequence[PreprocessRule] = (), by: Sequence[str] = ()) -> DataFrame:
    """Distinct cleaned lines with count, first and last time seen, highest level, first place and files.

    Counts and extremes combine before the shuffle; only distinct patterns reach anything else.
    """
    p = lines.where(F.trim("content") != "").withColumn("p", L.preprocess(F.col("content"), rules))
    rows = p.select(*by, F.col("p.cleaned").alias("pattern"), L.level_priority(F.col("p.level")).alias("priority"), F.col("p.level").alias("level"), "file_path", "line_no", F.col("content").alias("sample"), F.col("p.ts").alias("ts"))
    # One struct a place: its other fields come along, so each line is compared once for all of them.
    grouped = rows.groupBy(*by, "pattern").agg(
        F.count(F.lit(1)).alias("count"), F.max(F.struct("priority", "level")).alias("top"), F.min(F.struct("file_path", "line_no", "sample", "ts")).alias("first"),
        F.max(F.struct("file_path", "line_no", "ts")).alias("last"), F.array_sort(F.collect_set("file_path")).alias("files"),
    )
    return grouped.select(*by, "pattern", "count", "top.level", "top.priority", "first.sample", F.col("first.file_path").alias("sample_file"), F.col("first.line_no").alias("sample_line"), F.col("first.ts").alias("first_seen"), F.col("last.ts").alias("last_seen"), F.col("last.file_path").alias("last_file"), F.col("last.line_no").alias("last_line"), "files")


def _leaf_token(token):
    return F.when(token.rlike("[0-9]"), "<*>").otherwise(token)


def _with_leaf(masked: DataFrame, depth: int, wildcard_fallback: bool, by: Sequence[str]) -> DataFrame:
    """masked with tokens and leaf: token count and the first depth-1 tokens, those with a digit as <*>."""
    t = masked.withColumn("tokens", L.tokenize(F.col("pattern"))).where(F.size("tokens") > 0)
    head = F.transform(F.slice("tokens", 1, depth - 1), _leaf_token)
    t = t.withColumn("leaf", F.concat_ws("\x01", F.size("tokens").cast("string"), F.array_join(head, "\x01")))
    if wildcard_fallback:
        sizes = t.groupBy(*by, "leaf").agg(F.count(F.lit(1)).alias("leaf_n"))
        others = sizes.select(*by, F.col("leaf").alias("wild_leaf"), F.lit(True).alias("has"))
        t = t.join(sizes, [*by, "leaf"]).withColumn("wild_leaf", F.regexp_replace("leaf", "\x01[^\x01]*$", "\x01<*>")).join(others, [*by, "wild_leaf"], "left")
        t = t.withColumn("leaf", F.when((F.col("leaf_n") == 1) & F.col("has"), F.col("wild_leaf")).otherwise(F.col("leaf"))).drop("wild_leaf", "has", "leaf_n")
    return t


def leaf_parts(rows: DataFrame, similarity: float = 0.55, pair_limit: int = 64) -> DataFrame:
    """(id, part) of patterns (id, leaf, tokens): patterns of different parts never meet in a cluster.

    A pattern joins a cluster only if it shares `need` positions with the cluster's template: at most its own <*>
    positions, and for the rest tokens that every member of the cluster has there.  So two patterns of one cluster
    share need - (the joiner's <*> positions) tokens or more, and one of them is among any m - that + 1 of the
    joiner's m tokens, the rarest of the leaf here (prefix filter over (position, token) pairs).  Patterns that share a
    pair of up to `pair_limit` patterns are counted out one by one; those that share a more frequent one are linked
    through it without a count.  A pattern that its <*> positions alone let join anything makes its leaf one part.
    """
    rows = rows.select("id", F.xxhash64("leaf").alias("leaf"), "tokens", (F.ceil(F.size("tokens") * similarity - 1e-9) - F.size(F.filter("tokens", lambda x: x == "<*>"))).cast("int").alias("need"))
    node = lambda *c: (-F.abs(F.shiftright(F.xxhash64(*c), 1)) - 1).alias("node")
    items = rows.select("id", "leaf", F.posexplode("tokens").alias("pos", "token")).where("token <> '<*>'").select("id", node("leaf", "pos", "token"))
    often = items.groupBy("node").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = items.join(often, "node").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "node"))).alias("shared"))
    # Pairs that only this pattern has come first and meet nobody: m and the prefix both shrink by them.
    first = shared.join(rows.where("need > 0"), "id").withColumn("first", F.size("shared") - F.col("need") + 1).where("first > 0")
    first = written(first.select("id", "tokens", "need", F.explode(F.slice("shared", F.lit(1), F.col("first"))).alias("s")).select("id", "tokens", "need", "s.df", "s.node"), "prefixes")
    few = items.join(often.where(F.col("df") <= pair_limit), "node").select("node", F.col("id").alias("b")).join(rows.select(F.col("id").alias("b"), F.col("tokens").alias("other")), "b")
    same = F.size(F.filter(F.zip_with("tokens", "other", lambda x, y: (x == y) & (x != "<*>")), lambda x: x))
    pairs = first.where(F.col("df") <= pair_limit).join(few, "node").where(F.expr("id <> b") & (same >= F.col("need"))).select(F.col("id").alias("a"), "b")
    hot = first.where(F.col("df") > pair_limit).select("node").distinct()
    stars = items.join(hot, "node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    whole = rows.groupBy("leaf").agg(F.min("need").alias("least")).where("least <= 0").select("leaf")
    open_ = rows.join(whole, "leaf").select(F.col("id").alias("a"), node("leaf").alias("b"))
    labels = connected(pairs.unionByName(stars).unionByName(open_)).select(F.col("node").alias("id"), F.col("label").alias("part"))
    return rows.select("id").join(labels, "id", "left").select("id", F.coalesce("part", "id").alias("part"))


def greedy_steps(tokens: Sequence[Sequence[str]], similarity: float) -> Iterator[tuple[int, list[str]]]:
    """The cluster of each pattern (equally long lists, in order), and that cluster's template after it has joined.

    A pattern joins the cluster whose template agrees with it at most positions (the first of equals), if that is
    `similarity` of them or more; positions that differ become <*>.  Clusters that can agree so far are found by the
    rarest tokens of their first patterns.
    """
    size = len(tokens[0])
    need = next(k for k in range(size + 2) if k / size >= similarity or k > size)
    codes, names = {"<*>": 0}, ["<*>"]
    known = np.zeros((16, size), np.int32)  # a row of token codes for each cluster
    places: dict[tuple[int, int], list[int]] = {}
    n = 0
    for pattern in tokens:
        for x in pattern:
            if codes.setdefault(x, len(names)) == len(names):
                names.append(x)
        mine = np.array([codes[x] for x in pattern], np.int32)
        own = [(i, c) for i, c in enumerate(mine.tolist()) if c]
        least = need - (size - len(own))
        some = None
        if n > 64 and least > 0:
            lists = sorted((places.get(k, ()) for k in own), key=len)[: max(0, len(own) - least + 1)]
            some = np.array(sorted(set().union(*lists)), np.int64)
        same = (known[:n] == mine).sum(axis=1) if some is None else (known[some] == mine).sum(axis=1)
        at = int(np.argmax(same)) if len(same) else -1
        if at >= 0 and same[at] >= need:
            at = at if some is None else int(some[at])
            known[at][known[at] != mine] = 0
        else:
            at, n = n, n + 1
            if at == len(known):
                known = np.concatenate([known, np.zeros_like(known)])
            known[at] = mine
            for k in own:
                places.setdefault(k, []).append(at)
        yield at, [names[c] for c in known[at].tolist()]


def greedy_clusters(tokens: Sequence[Sequence[str]], similarity: float) -> tuple[list[int], list[list[str]]]:
    """The cluster of each pattern, and the clusters' templates."""
    out, found = [], {}
    for at, template in greedy_steps(tokens, similarity):
        out.append(at)
        found[at] = template
    return out, [found[c] for c in range(len(found))]


def _coded(patterns: pd.Series, templates: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Token codes of patterns and of templates, <*> as 0."""
    rows = patterns.tolist() + templates.tolist()
    flat = np.array(["<*>", *(x for r in rows for x in r)], object)
    codes = pd.factorize(flat)[0][1:].astype(np.int32).reshape(len(rows), -1)
    return codes[: len(patterns)], codes[len(patterns) :]


def _turns(p: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """The patterns of one leaf whose turn opens or changes a cluster, with the cluster's number and its tokens from then on."""
    p = p.sort_values(["sample_file", "sample_line", "pattern"]).reset_index(drop=True)
    at, tokens, cluster = [], [], []
    known: list[list[str]] = []
    for i, (c, found) in enumerate(greedy_steps(p["tokens"].tolist(), similarity)):
        if c == len(known) or known[c] != found:
            known[c : c + 1] = [found]
            at.append(i), tokens.append(found), cluster.append(c)
    out = p.loc[at, ["leaf", "id", "sample_file", "sample_line", "pattern"]]
    return out.assign(cluster=np.array(cluster, np.int64), found=tokens)


def _held(p: pd.DataFrame, turns: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """(id, cluster, kept) of some patterns of a leaf, given its turns: the cluster each joins at its own time, and whether
    it does so without changing anything, which is what the turns say of it."""
    place = ["sample_file", "sample_line", "pattern"]
    if p.empty or turns.empty:
        return pd.DataFrame({"id": p["id"], "cluster": np.full(len(p), -1), "kept": np.zeros(len(p), bool)})
    turns = turns.sort_values(place).reset_index(drop=True)
    mine, theirs = _coded(p["tokens"], turns["found"])
    size = mine.shape[1]
    need = next(k for k in range(size + 2) if k / size >= similarity or k > size)
    both = pd.concat([turns[place].assign(turn=range(len(turns))), p[place].assign(turn=-1)], ignore_index=True)
    both["at"] = [*([-1] * len(turns)), *range(len(p))]
    both = both.sort_values(place, kind="stable")
    seen = np.maximum.accumulate(both["turn"].to_numpy())
    own = both["at"].to_numpy() >= 0
    after = np.empty(len(p), np.int64)  # the last turn before a pattern, or its own
    after[both["at"].to_numpy()[own]] = seen[own]
    turn_of = dict(zip(turns["id"].tolist(), range(len(turns))))
    cluster, kept = np.full(len(p), -1), np.zeros(len(p), bool)
    known = np.zeros((0, size), np.int32)
    number = turns["cluster"].to_numpy()
    order = np.argsort(after, kind="stable")
    starts = np.searchsorted(after[order], np.arange(len(turns) + 1))
    for k in range(len(turns)):
        known = np.vstack([known, theirs[k : k + 1]]) if number[k] == len(known) else known
        known[number[k]] = theirs[k]
        step = max(1, 20_000_000 // known.size)
        for a in range(starts[k], starts[k + 1], step):
            some = order[a : min(a + step, starts[k + 1])]
            same = (mine[some][:, None, :] == known[None]).sum(axis=2)
            best = same.argmax(axis=1)
            fits = ((known[best] == mine[some]) | (known[best] == 0)).all(axis=1)
            cluster[some], kept[some] = best, (same.max(axis=1) >= need) & fits
    for i, x in enumerate(p["id"].tolist()):
        if x in turn_of:
            cluster[i], kept[i] = number[turn_of[x]], True
    return pd.DataFrame({"id": p["id"].to_numpy(), "cluster": cluster, "kept": kept})


def _walked_apart(rows: DataFrame, similarity: float, rows_per_shard: int, leaf_limit: int) -> tuple[DataFrame | None, DataFrame]:
    """(id, first_id, template) of leaves that few patterns change, and the leaves (leaf) that are left.

    Shards of a leaf are walked alone; the patterns that change something there are walked together, which gives turns.
    Then every pattern is held against the clusters as the turns say they were at its time.  One that would change
    something joins those walked together, and all is done again until there is none.  The first such pattern in order is
    always one of the true walk, so what is left without one is the walk over the whole leaf, pattern by pattern.
    """
    sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.first("tokens").alias("x"))
    shard = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / rows_per_shard)).alias("shard")
    dealt = written(rows.join(F.broadcast(sizes.select("leaf", "n")), "leaf").select(*rows.columns, "n", shard), "dealt")
    turn = "leaf string, id long, sample_file string, sample_line long, pattern string, cluster long, found array<string>"
    alone = written(dealt.groupBy("leaf", "shard").applyInPandas(lambda p: _turns(p, similarity), turn), "turns").select("leaf", "id")
    few = alone.groupBy("leaf").agg(F.count(F.lit(1)).alias("turns")).join(sizes, "leaf").where(F.col("turns") <= F.greatest(F.lit(leaf_limit), 16 * F.ceil(F.col("n") / rows_per_shard))).where(F.col("turns") < F.col("n") / 2)
    few = written(few.select("leaf"), "leaves")
    rest = sizes.select("leaf").join(few, "leaf", "left_anti")
    if few.isEmpty():
        return None, rest
    dealt = dealt.join(few, "leaf", "left_semi")
    chunks = dealt.select("leaf", "shard").distinct()
    asked = alone.join(few, "leaf", "left_semi").select("id")
    while True:
        turns = written(dealt.join(asked, "id", "left_semi").groupBy("leaf").applyInPandas(lambda p: _turns(p, similarity), turn), "turns")
        sent = written(turns.join(chunks, "leaf"), "sent")
        held = dealt.groupBy("leaf", "shard").cogroup(sent.groupBy("leaf", "shard")).applyInPandas(lambda p, q: _held(p, q, similarity), "id long, cluster long, kept boolean")
        held = written(held, "held")
        odd = held.where("NOT kept").select("id")
        if odd.isEmpty():
            break
        asked = written(asked.unionByName(odd).distinct(), "asked")
    place = F.struct("sample_file", "sample_line", "pattern")
    clusters = turns.groupBy("leaf", "cluster").agg(F.min_by("id", place).alias("first_id"), F.array_join(F.max_by("found", place), " ").alias("template"))
    return dealt.select("id", "leaf").join(held, "id").join(clusters, ["leaf", "cluster"]).select("id", "first_id", "template"), rest


def merge_templates(masked: DataFrame, similarity: float = 0.55, depth: int = 4, wildcard_fallback: bool = False, by: Sequence[str] = (), leaf_limit: int = 10_000, rows_per_shard: int = 10_000) -> DataFrame:
    """Greedy clustering of distinct patterns that share token count and first depth-1 tokens.

    Patterns come in order of their first place; one joins the most similar cluster of its leaf if at least
    `similarity` of the positions agree, and differing positions become <*>.  Leaves of more than `leaf_limit` patterns
    are walked in shards where few patterns change a cluster (_walked_apart), else split into parts that cannot influence
    each other (leaf_parts), so the clusters are those of one walk over the leaf, whatever the limit.  Only tokens and places go through Python; counts, levels and files are joined back and
    aggregated by Spark.  wildcard_fallback sends a pattern whose last leaf token is alone in its leaf to the leaf that
    has <*> there, when there is one.
    """
    masked = written(masked, "masked") if wildcard_fallback else masked
    t = written(_with_leaf(masked, depth, wildcard_fallback, by).withColumn("id", F.monotonically_increasing_id()), "patterns")
    group = F.concat_ws("\x02", *[F.coalesce(F.col(c).cast("string"), F.lit("\x03")) for c in by], "leaf")
    rows = t.select("id", group.alias("leaf"), "tokens", "pattern", "sample_file", "sample_line")
    big = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf_limit).select("leaf")
    apart = None
    if big.isEmpty():
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    else:
        big = written(big, "big")
        apart, rest = _walked_apart(rows.join(big, "leaf", "left_semi"), similarity, rows_per_shard, leaf_limit)
        rest = written(rest, "rest")
        small = rows.join(big, "leaf", "left_anti").withColumn("part", F.lit(0).cast("long"))
        if rest.isEmpty():
            rows = small
        else:
            large = rows.join(rest, "leaf", "left_semi")
            rows = small.unionByName(large.join(leaf_parts(large, similarity), "id"))

    def walk(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["leaf", "part", "sample_file", "sample_line", "pattern"])
        leaf, part, ids, tokens = p["leaf"].to_numpy(), p["part"].to_numpy(), p["id"].to_numpy(), p["tokens"].tolist()
        edges = [0, *(np.flatnonzero((leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(p)]
        first, template = [], []
        for a, b in zip(edges, edges[1:]):
            cluster, found = greedy_clusters(tokens[a:b], similarity)
            first.append(ids[a:b][np.unique(cluster, return_index=True)[1]][cluster])
            template += [" ".join(found[c]) for c in cluster]
        return pd.DataFrame({"id": ids, "first_id": np.concatenate(first), "template": template})

    shards = -(-t.count() // rows_per_shard)  # small parts share a task
    shard = F.pmod(F.xxhash64("leaf", "part"), F.lit(max(1, shards)))
    walked = rows.groupBy(shard.alias("shard")).applyInPandas(walk, "id long, first_id long, template string")
    walked = walked if apart is None else walked.unionByName(apart)
    place, last = F.struct("sample_file", "sample_line", "pattern"), F.struct("last_file", "last_line")
    out = t.join(walked, "id").groupBy(*by, "first_id").agg(
        F.min("template").alias("template"), F.sum("count").alias("count"), F.min_by("level", F.struct(-F.col("priority"), place)).alias("level"),
        F.min_by("sample", place).alias("sample"), F.min(place).alias("first"), F.min_by("first_seen", place).alias("first_seen"), F.max_by("last_seen", last).alias("last_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("files")))).alias("files"),
    )
    return out.select(*by, F.col("template").alias("pattern"), "count", "level", "sample", F.col("first.sample_file").alias("sample_file"), F.col("first.sample_line").alias("sample_line"), "first_seen", "last_seen", "files")


def match_templates(masked: DataFrame, known: DataFrame, similarity: float = 0.55, depth: int = 4) -> DataFrame:
    """masked (pattern, count, ...) with `template`: the pattern of known, stored templates that agrees with it at most
    positions, if at `similarity` of them or more (the smallest of equals by text), else null.

    A pattern meets the templates of its leaf (token count and first tokens) that share one of its rarest tokens at the
    same position, as many as it can lack and still agree; where its own <*> positions might do alone, all of its leaf.
    """
    masked = written(masked, "masked")
    rows = _with_leaf(masked, depth, False, ()).select("pattern", "tokens", F.xxhash64("leaf").alias("leaf")).withColumn("id", F.xxhash64("pattern"))
    stored = _with_leaf(known.select("pattern").distinct(), depth, False, ()).select(F.col("pattern").alias("template"), F.col("tokens").alias("stored"), F.xxhash64("leaf").alias("leaf"))
    fixed = lambda t, c: t.select("*", F.posexplode(c).alias("pos", "token")).where("token <> '<*>'").withColumn("item", F.xxhash64("leaf", "pos", "token"))
    need = (F.ceil(F.size("tokens") * similarity - 1e-9) - F.size(F.filter("tokens", lambda x: x == "<*>"))).cast("int")
    rows = rows.withColumn("need", need)
    items = fixed(stored, "stored").select("item", "template", "stored")
    often = items.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    # Tokens that no template has come first and meet nothing: what is left of the prefix are the known tokens' rarest.
    mine = fixed(rows.where("need > 0"), "tokens").join(often, "item").groupBy("id", "pattern").agg(F.first("tokens").alias("tokens"), F.first("need").alias("need"), F.array_sort(F.collect_list(F.struct("df", "item"))).alias("known"))
    mine = mine.withColumn("first", F.size("known") - F.col("need") + 1).where("first > 0").select("pattern", "tokens", F.explode(F.slice("known", F.lit(1), F.col("first"))).alias("k"))
    met = mine.select("pattern", "tokens", F.col("k.item").alias("item")).join(items, "item").select("pattern", "tokens", "template", "stored")
    met = met.unionByName(rows.where("need <= 0").join(stored, "leaf").select("pattern", "tokens", "template", "stored"))
    same = F.size(F.filter(F.zip_with("tokens", "stored", lambda x, y: x == y), lambda x: x))
    best = met.withColumn("same", same).where(F.col("same") / F.size("tokens") >= similarity).groupBy("pattern").agg(F.min_by("template", F.struct(-F.col("same"), "template")).alias("template"))
    return masked.join(best, "pattern", "left")


def templates(lines: DataFrame, rules: Sequence[PreprocessRule] = (), head: int | None = None, similarity: float = 0.55, depth: int = 4, limit: int | None = None) -> DataFrame:
    """Templates of lines, most frequent first; `limit` keeps the top ones."""
    merged = merge_templates(masked_patterns(head_per_file(lines, head), rules), similarity, depth)
    out = merged.withColumn("id", L.template_id(L.tokenize(F.col("pattern")))).orderBy(F.desc("count"), "pattern")
    return out if limit is None else out.limit(limit)


def pattern_frequency(lines: DataFrame, rules: Sequence[PreprocessRule] = (), by: str = "level") -> DataFrame:
    """Counts of masked patterns by level or by hour."""
    p = lines.where(F.trim("content") != "").withColumn("p", L.preprocess(F.col("content"), rules))
    key = F.col("p.level") if by == "level" else F.date_format(F.date_trunc("hour", L.parse_log_time(F.col("p.ts"))), "yyyy-MM-dd HH:mm:ss")
    return p.groupBy(F.col("p.cleaned").alias("pattern"), key.alias(by)).agg(F.count(F.lit(1)).alias("n"))
