"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the URLs that no rule fits.

Everything is DataFrame expressions. Features are lengths, depth, digit ratios, entropy, counts of parameters, labels and hyphens, and
statistics of the host's suffixes of one to three labels, learned from labelled URLs. The trees are grown by levels: one aggregation gives the sums of
gradients and Hessians by node, feature and bin, of which there are at most 2^DEPTH x features x BINS, and the driver takes the best cuts. A
tree is a CASE expression over the features.

Labels: the tables hold none for URLs, so the query labels them by words of the host, stated in UNWANTED; what the model learns is how such
hosts look, by features that hold no word. The sample is bounded by the parameter `rows`.

Nulls: a null url has neither host nor path, fits no rule and is judged by its features, all zero. Very long URLs are read whole. Repeated rows
each get their verdict. Without labelled URLs, or with labels of one kind only, the trees are none and the verdict is that of the labels' share. An
empty table gives an empty result. Columns other than the id and the url are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import discard, hash_sample, stored

#: Verdict, host, path of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Parts of a host's labels, between dots and hyphens, that name what is not wanted.
UNWANTED = ("ads", "adult", "bet", "bets", "casino", "clicks", "deals", "escort", "farm", "loans", "pills", "poker", "porn", "promo", "replica", "sex", "spam", "track", "tracker", "viagra", "warez", "xxx")
#: Cuts of a feature, levels of a tree, trees, step, penalty of a leaf's square.
BINS, DEPTH, TREES, STEP, PENALTY = 24, 3, 8, 0.5, 1.0
#: Weight of the prior in a suffix's share.
PRIOR = 4.0
SUFFIXES = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, number sign or the end, A-Z in lower case; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, number sign or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none does. A chain of conditions, longest first: for short lists."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, own + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits a character, with all characters beyond a-z and 0-9 as one."""
    size = F.length(text).cast("double")
    seen = [(F.length(text) - F.length(F.replace(text, F.lit(c)))).cast("double") for c in _LOWER + "0123456789"]
    other = F.length(F.regexp_replace(text, "[a-z0-9]", "")).cast("double")
    logs = F.aggregate(F.array(*seen, other), F.lit(0.0), lambda s, k: s + F.when(k > 1, k * F.log2(k)).otherwise(0.0))
    return F.when(size > 0, F.log2(size) - logs / size).otherwise(0.0)


def _digits(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / n).otherwise(0.0)


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what)))) / len(what)


def lexical(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with _host, _path, the host's suffixes _suffix1 to _suffix3 and the features f0, f1, ..."""
    host, path = F.col("_host"), F.col("_path")
    text = F.translate(F.coalesce(F.col(url), F.lit("")), _UPPER, _LOWER)
    query = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    labels = F.split(host, r"\.")
    features = [
        F.length(text),
        F.length(host),
        F.length(path),
        _count(path, "/"),
        _digits(text),
        _digits(host),
        _entropy(text),
        _entropy(host),
        F.when(query == "", 0).otherwise(F.size(F.filter(F.split(query, "&"), lambda p: p != ""))),
        F.size(labels),
        F.array_max(F.transform(labels, F.length)),
        _count(host, "-"),
    ]
    suffix = [F.substring_index(host, ".", -k).alias(f"_suffix{k}") for k in range(1, SUFFIXES + 1)]
    own = pages.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    return own.select("*", *suffix, *[f.cast("double").alias(f"f{k}") for k, f in enumerate(features)])


LEXICAL = 12


@dataclass
class Model:
    """suffixes: suffix, rows and blocked ones of the labelled URLs; share: blocked of all; trees: CASE expressions over f0, f1, ... ."""

    suffixes: DataFrame
    share: float
    start: float
    trees: list[str] = field(default_factory=list)

    def margin(self) -> Column:
        return F.expr(" + ".join([_double(self.start), *self.trees]))


def _with_suffixes(df: DataFrame, suffixes: DataFrame, share: float, own: Column | None = None) -> DataFrame:
    """df with two features for each suffix: its smoothed share of blocked labels and the log of its rows. own: the row's label, which it doesn't count."""
    for k in range(1, SUFFIXES + 1):
        table = suffixes.select(F.col("suffix").alias(f"_suffix{k}"), F.col("n").alias("_n"), F.col("y").alias("_y"))
        df = df.join(F.broadcast(table), f"_suffix{k}", "left")  # at most SUFFIXES rows a labelled URL of the sample
        n, y = (F.coalesce(F.col(c), F.lit(0)) for c in ("_n", "_y"))
        if own is not None:
            n, y = n - 1, y - own
        at = LEXICAL + 2 * (k - 1)
        df = df.withColumns({f"f{at}": (y + PRIOR * share) / (n + PRIOR), f"f{at + 1}": F.log1p(n.cast("double"))}).drop("_n", "_y")
    return df


def unwanted(urls: DataFrame, url: str = "url") -> DataFrame:
    """url, y: 1 for URLs whose host has one of UNWANTED between its dots and hyphens, 0 for the others; null URLs have no label."""
    parts = F.split(host_of(F.col(url)), "[.-]")
    return urls.select(F.col(url).alias("url"), F.arrays_overlap(parts, F.array(*map(F.lit, UNWANTED))).cast("int").alias("y")).filter(F.col("url").isNotNull())


def fit(labelled: DataFrame, rows: int = 4000) -> Model:
    """labelled: url, y (0 or 1, the most of a url's labels counts). At most `rows` URLs of each label, the first by a hash."""
    each = labelled.filter(F.col("url").isNotNull() & F.col("y").isin(0, 1)).groupBy("url").agg(F.max("y").alias("y"))
    sample = stored(lexical(hash_sample(each, "url", "y", rows).select("url", "y")), "labelled-urls")
    number = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    all_rows = sum(number.values())
    share = number.get(1, 0) / all_rows if all_rows else 0.0
    kept = sample.select("y", F.explode(F.array_distinct(F.array(*[F.col(f"_suffix{k}") for k in range(1, SUFFIXES + 1)]))).alias("suffix"))
    suffixes = stored(kept.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")), "suffixes")
    clipped = min(max(share, 1e-3), 1 - 1e-3)
    model = Model(suffixes, share, math.log(clipped / (1 - clipped)))
    if len(number) == 2:
        _grow(model, _with_suffixes(sample, suffixes, share, F.col("y")))
    discard(sample)
    return model


def _grow(model: Model, df: DataFrame) -> None:
    names = [f"f{k}" for k in range(LEXICAL + 2 * SUFFIXES)]
    ranks = [(i + 1) / BINS for i in range(BINS - 1)]
    found = df.agg(*[F.percentile_approx(c, ranks, 10_000).alias(c) for c in names]).first()
    edges = {c: sorted(set(found[c])) for c in names}
    bins = [_bin(F.col(c), edges[c]).alias(f"b{k}") for k, c in enumerate(names)]
    # rows of the same bins and label are one
    table = stored(df.select("y", *bins).groupBy("y", *[f"b{k}" for k in range(len(names))]).agg(F.count(F.lit(1)).alias("w")), "binned-urls")
    by_bin = _double(model.start)
    for _ in range(TREES):
        cuts: dict[int, tuple[int, int]] = {}  # node: feature, last bin that goes left
        leaves: dict[int, float] = {}
        for depth in range(DEPTH):
            for node, own in _histograms(table, by_bin, _case(cuts, {n: str(n) for n in range(1, 2 << depth)}, "b{} <= {}"), len(names)).items():
                cut, left, right = _best(own)
                if cut is None:
                    leaves[node] = left
                else:
                    cuts[node] = cut
                    leaves[2 * node], leaves[2 * node + 1] = left, right
        if not cuts:
            break
        ends = {n: _double(STEP * v) for n, v in leaves.items()}
        by_bin += " + " + _case(cuts, ends, "b{} <= {}")
        values = {n: (f, _double(edges[names[f]][b])) for n, (f, b) in cuts.items()}
        model.trees.append(_case(values, ends, "f{} <= {}"))
    discard(table)


def _double(value: float) -> str:
    """The literal of a double in SQL; without the letter it would be a decimal number."""
    return f"{float(value)!r}D"


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < value))


def _case(cuts: dict[int, tuple], ends: dict[int, str], test: str, node: int = 1) -> str:
    """The tree below a node as nested CASE expressions; node k has the nodes 2k (test holds) and 2k + 1 below it."""
    if node not in cuts:
        return ends[node]
    return f"(CASE WHEN {test.format(*cuts[node])} THEN {_case(cuts, ends, test, 2 * node)} ELSE {_case(cuts, ends, test, 2 * node + 1)} END)"


def _histograms(table: DataFrame, margin: str, node: str, features: int) -> dict[int, dict[tuple[int, int], tuple[float, float]]]:
    """By node, then feature and bin: sums of gradients and Hessians of the logistic loss."""
    p = 1 / (1 + F.exp(-F.expr(margin)))
    each = table.select(F.expr(node).alias("node"), (F.col("w") * (p - F.col("y"))).alias("g"), (F.col("w") * p * (1 - p)).alias("h"), F.posexplode(F.array(*[F.col(f"b{k}") for k in range(features)])).alias("f", "b"))
    out: dict[int, dict[tuple[int, int], tuple[float, float]]] = {}
    for r in each.groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out.setdefault(r["node"], {})[r["f"], r["b"]] = r["g"], r["h"]
    return out


def _best(own: dict[tuple[int, int], tuple[float, float]]) -> tuple[tuple[int, int] | None, float, float]:
    """((feature, last bin to the left), value left, value right) of the cut of most gain; without a gain (None, value, value)."""
    g = sum(v[0] for (f, _), v in own.items() if f == 0)
    h = sum(v[1] for (f, _), v in own.items() if f == 0)
    best, cut, values = 1e-6, None, (-g / (h + PENALTY),) * 2
    at, gl, hl = -1, 0.0, 0.0
    for f, b in sorted(own):
        if f != at:
            at, gl, hl = f, 0.0, 0.0
        gl, hl = gl + own[f, b][0], hl + own[f, b][1]
        gr, hr = g - gl, h - hl
        if hl < 1e-3 or hr < 1e-3:
            continue
        gain = gl * gl / (hl + PENALTY) + gr * gr / (hr + PENALTY) - g * g / (h + PENALTY)
        if gain > best + 1e-9:
            best, cut, values = gain, (f, b), (-gl / (hl + PENALTY), -gr / (hr + PENALTY))
    return cut, *values


def judge(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """key, host, path, rule, verdict, score (the model's share of blocked, of every URL)."""
    scored = _with_suffixes(lexical(pages.select(key, url), url), model.suffixes, model.share)
    rule, verdict = _by_rule(F.col("_host"), F.col("_path"), rules)
    score = 1 / (1 + F.exp(-model.margin()))
    out = scored.select(key, F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), verdict.alias("_by_rule"), score.alias("score"))
    return out.select(key, "host", "path", "rule", F.coalesce("_by_rule", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
