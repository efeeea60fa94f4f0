"""URL filters: rules by host and path, and gradient-boosted trees where no rule fits.

Everything runs as DataFrame expressions. A url's lexical features are columns; the
statistics of its suffixes come from small broadcast tables; a trained ensemble is a sum
of CASE expressions over the features. Training adds the gradients of a logistic loss in
histograms (node, feature, bin), an aggregation for each level of a tree, and only these
sums reach the driver, which picks the splits.

The model is fitted on a bounded sample of the labelled urls, drawn by hash; all urls are judged.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame, functions as F

from passagelake.session import reliable

ALLOW, BLOCK = "allow", "block"
#: Different labelled urls that a model is fitted on, about; all of them, if there are fewer.
TRAIN_URLS = 20_000
#: Rules become one CASE expression.
MOST_RULES = 1_000
TREES, DEPTH, RATE, PENALTY = 12, 3, 0.3, 1.0
BINS = 16
#: A suffix's share of blocked urls is smoothed as if it had been seen so often more.
PRIOR = 10.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = ["tld", "site", "extension", "directory"]
FEATURES = [
    "length", "host_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "params", "fragment",
    *[f"{s}_share" for s in SUFFIXES], *[f"{s}_seen" for s in SUFFIXES],
]


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @classmethod
    def parse(cls, text: str, verdict: str) -> Rule:
        """A rule written like ``example.org/en/``; without a slash it fits every path."""
        host, slash, path = text.partition("/")
        return cls(host.translate(str.maketrans(UPPER, LOWER)), slash + path, verdict)

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; else ''."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; else ''."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, or nulls; of equally long ones the first by text."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = rule.fits(host, path)
        text, verdict = (F.when(fits, F.lit(a)).otherwise(b) for a, b in ((rule.text, text), (rule.verdict, verdict)))
    return text, verdict


def entropy(text: Column) -> Column:
    """Bits of a character, by the shares of the characters; 0 for the empty text.

    The characters are sorted, and the runs of equal ones are summed in one pass.
    """
    characters = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def bits(run: Column) -> Column:
        return F.when(run > 0, run * F.log2(run)).otherwise(0.0)

    def step(held: Column, c: Column) -> Column:
        same = held["c"] == c
        return F.struct(
            c.alias("c"),
            F.when(same, held["run"] + 1.0).otherwise(1.0).alias("run"),
            F.when(same, held["total"]).otherwise(held["total"] + bits(held["run"])).alias("total"),
        )

    length = F.char_length(text)
    runs = F.aggregate(characters, start, step, lambda held: held["total"] + bits(held["run"]))
    return F.when(length > 0, F.log2(length.cast("double")) - runs / length).otherwise(0.0)


def with_lexical(urls: DataFrame, url: str = "_url") -> DataFrame:
    """Lexical features and suffixes of ``url`` beside _host and _path; all names with an underscore in front."""
    text, host, path = F.coalesce(F.col(url), F.lit("")), F.col("_host"), F.col("_path")
    length = F.char_length(text).cast("double")
    query = F.split(F.regexp_extract(text, r"\?([^#]*)", 1), "&")
    last = F.element_at(F.split(path, "/"), -1)
    features = {
        "length": length,
        "host_length": F.char_length(host),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        "labels": F.size(F.split(host, r"\.")),
        "digit_ratio": F.when(length > 0, 1 - F.char_length(F.translate(text, "0123456789", "")) / length).otherwise(0),
        "hyphens": F.char_length(host) - F.char_length(F.translate(host, "-", "")),
        "entropy": entropy(text),
        "params": F.size(F.filter(query, lambda p: p != "")),
        "fragment": F.when(F.instr(text, "#") > 0, 1).otherwise(0),
    }
    suffixes = {
        "tld": F.substring_index(host, ".", -1),
        "site": F.substring_index(host, ".", -2),
        "extension": F.when(F.instr(last, ".") > 0, F.substring_index(last, ".", -1)).otherwise(F.lit("")),
        "directory": F.regexp_extract(path, "^/([^/]*)/", 1),
    }
    named = {f"_{k}": v.cast("double") for k, v in features.items()} | {f"_{k}": v for k, v in suffixes.items()}
    return urls.withColumns(named)


@dataclass
class Model:
    """A fitted ensemble. ``trees`` are nested tuples (feature, threshold, left, right), leaves are numbers."""

    statistics: dict[str, DataFrame]
    #: Blocked urls among the labelled ones; the trees start from its log odds.
    share: float
    trees: list = field(default_factory=list)

    @property
    def start(self) -> float:
        return log(self.share / (1 - self.share))


def _with_statistics(urls: DataFrame, statistics: dict[str, DataFrame], blocked_share: float, fold: Column | None):
    """Suffix shares and counts; for training those of the other half of the sample."""
    for name in SUFFIXES:
        table = statistics[name].withColumnRenamed("suffix", f"_{name}")
        urls = urls.join(F.broadcast(table), f"_{name}", "left")
        seen, blocked = F.col("seen"), F.col("blocked")
        if fold is not None:
            seen, blocked = (F.when(fold == 0, c - F.col(f"{n}_0")).otherwise(F.col(f"{n}_0")) for n, c in (("seen", seen), ("blocked", blocked)))
        seen, blocked = F.coalesce(seen, F.lit(0)), F.coalesce(blocked, F.lit(0))
        urls = urls.withColumns(
            {f"_{name}_share": (blocked + PRIOR * blocked_share) / (seen + PRIOR), f"_{name}_seen": F.log1p(seen)}
        ).drop("seen", "blocked", "seen_0", "blocked_0")
    return urls


def _codes(thresholds: list[list[float]]) -> Column:
    """The bin of each feature: how many of its thresholds lie below it."""
    return F.array(
        *[
            sum((F.when(F.col(f"_{name}") > t, 1).otherwise(0) for t in cuts), F.lit(0))
            for name, cuts in zip(FEATURES, thresholds)
        ]
    )


def _value(tree, feature) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    name, cut, left, right = tree
    return F.when(feature(name) > cut, _value(right, feature)).otherwise(_value(left, feature))


def _node(tree, feature, path: int = 1) -> Column:
    """The number of the open leaf that a row falls into; a row in a closed one has 0."""
    if tree is None or isinstance(tree, float):
        return F.lit(path if tree is None else 0)
    name, cut, left, right = tree
    return F.when(feature(name) > cut, _node(right, feature, 2 * path + 1)).otherwise(_node(left, feature, 2 * path))


def _split(sums: dict, total: tuple[float, float]):
    """The best (feature, bin) of a node by its histogram, with the sums of both sides; None if nothing is gained."""
    best = None
    for feature in sorted({f for f, _ in sums}):
        left_g = left_h = 0.0
        for b in range(BINS):
            g, h = sums.get((feature, b), (0.0, 0.0))
            left_g, left_h = left_g + g, left_h + h
            right_g, right_h = total[0] - left_g, total[1] - left_h
            if left_h < 1e-6 or right_h < 1e-6:
                continue
            gain = sum(x * x / (w + PENALTY) for x, w in ((left_g, left_h), (right_g, right_h)))
            gain = round(gain - total[0] ** 2 / (total[1] + PENALTY), 9)
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = gain, feature, b, (left_g, left_h), (right_g, right_h)
    return best


def _leaf(sums: tuple[float, float]) -> float:
    return float(RATE * sums[0] / (sums[1] + PENALTY))


def _grown(tree, path: int, splits: dict, last: bool):
    """The tree with its open leaves split; leaves that are not, and the last ones, get their value."""
    if tree is not None and not isinstance(tree, float):
        feature, cut, left, right = tree
        return feature, cut, _grown(left, 2 * path, splits, last), _grown(right, 2 * path + 1, splits, last)
    if tree is not None or path not in splits:
        return 0.0 if tree is None else tree
    total, best = splits[path]
    if best is None:
        return _leaf(total)
    _, feature, b, left, right = best
    return (feature, b, _leaf(left), _leaf(right)) if last else (feature, b, None, None)


def train(labelled: DataFrame, url_col: str = "url", blocked: Column | None = None) -> Model | None:
    """Fit the trees to ``labelled`` urls; ``blocked`` is a boolean. None if there are no labelled urls.

    Urls and labels that are null take no part, repeated ones count once. Above
    TRAIN_URLS different ones a sample is drawn by the url's hash.
    """
    blocked = F.col("blocked") if blocked is None else blocked
    rows = labelled.select(F.col(url_col).alias("_url"), blocked.cast("int").alias("_y")).dropna()
    different = rows.agg(F.approx_count_distinct("_url")).first()[0]
    if not different:
        return None
    drawn = F.pmod(F.xxhash64("_url"), F.lit(1 << 30)) < int(min(1.0, TRAIN_URLS / different) * (1 << 30))
    parts = rows.where(drawn).distinct().withColumns({"_host": host_of(F.col("_url")), "_path": path_of(F.col("_url"))})
    sample = reliable(with_lexical(parts).withColumn("_fold", F.pmod(F.hash("_url"), F.lit(2))))
    n, positive = sample.agg(F.count(F.lit(1)), F.sum("_y")).first()
    if not n:
        return None
    statistics = {}
    for name in SUFFIXES:
        zero = F.col("_fold") == 0
        counted = sample.groupBy(F.col(f"_{name}").alias("suffix")).agg(
            F.count(F.lit(1)).alias("seen"),
            F.sum("_y").alias("blocked"),
            F.sum(F.when(zero, 1).otherwise(0)).alias("seen_0"),
            F.sum(F.when(zero, F.col("_y")).otherwise(0)).alias("blocked_0"),
        )
        statistics[name] = reliable(counted.coalesce(1))
    share = (positive + 1) / (n + 2)
    featured = reliable(_with_statistics(sample, statistics, share, F.col("_fold")).coalesce(1))
    quantiles = [i / BINS for i in range(1, BINS)]
    found = featured.agg(*[F.percentile_approx(f"_{name}", quantiles, 10_000).alias(name) for name in FEATURES]).first()
    thresholds = [sorted(set(found[name])) for name in FEATURES]
    # The sample is bounded: it is one small table, and no level of a tree needs a shuffle.
    coded = reliable(featured.select("_y", _codes(thresholds).alias("codes")).coalesce(1)).coalesce(1)
    model = Model(statistics, share)
    by_bin: list = []
    for _ in range(TREES):
        tree = None
        score = sum((_value(t, lambda f: F.col("codes")[f]) for t in by_bin), F.lit(model.start))
        p = 1 / (1 + F.exp(-score))
        gradients = coded.select("codes", (F.col("_y") - p).alias("g"), (p * (1 - p)).alias("h"))
        for level in range(DEPTH):
            node = _node(tree, lambda f: F.col("codes")[f])
            cells = gradients.select(node.alias("node"), "g", "h", F.posexplode("codes").alias("feature", "bin"))
            sums: dict = {}
            for r in cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                if r.node:
                    sums.setdefault(r.node, {})[r.feature, r.bin] = r.g, r.h
            splits = {}
            for number, cell in sums.items():
                one = [v for (f, _), v in sorted(cell.items()) if f == 0]
                total = sum(g for g, _ in one), sum(h for _, h in one)
                splits[number] = total, _split(cell, total)
            tree = _grown(tree, 1, splits, level == DEPTH - 1)
        by_bin.append(tree)
    model.trees = [_by_threshold(t, thresholds) for t in by_bin]
    return model


def _by_threshold(tree, thresholds):
    """The same tree over the features' own values: a bin above b means a value above its b-th threshold."""
    if isinstance(tree, float):
        return tree
    feature, b, left, right = tree
    return FEATURES[feature], thresholds[feature][b], _by_threshold(left, thresholds), _by_threshold(right, thresholds)


def judge(
    urls: DataFrame,
    rules: list[Rule],
    model: Model | None,
    url_col: str = "url",
    keep: tuple[str, ...] = ("page_id",),
) -> DataFrame:
    """The columns ``keep`` of every row, with host, path, rule, verdict and score.

    The longest fitting rule decides; without one, urls whose score, the model's
    probability of being blocked, is above one half are blocked (without a model none is,
    score null). Null and empty urls, and urls without ``://``, have an empty host and path,
    which no rule with a host fits; they are judged by the model. Rows that repeat are judged
    each; other columns are not looked at.
    """
    url = F.col(url_col).cast("string")
    rows = urls.select(*keep, url.alias("_url"), host_of(url).alias("_host"), path_of(url).alias("_path"))
    if model is None:
        rows = rows.withColumn("_score", F.lit(None).cast("double"))
    else:
        rows = _with_statistics(with_lexical(rows), model.statistics, model.share, None)
        total = sum((_value(t, lambda f: F.col(f"_{f}")) for t in model.trees), F.lit(model.start))
        rows = rows.withColumn("_score", 1 / (1 + F.exp(-total)))
    rule, verdict = matched_rule(F.col("_host"), F.col("_path"), rules)
    judged = F.when(F.col("_score") > 0.5, BLOCK).otherwise(ALLOW)
    return rows.select(
        *keep,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        rule.alias("rule"),
        F.coalesce(verdict, judged).alias("verdict"),
        F.col("_score").alias("score"),
    )


def labelled_by_rules(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """The urls that a rule decides: (url, blocked)."""
    url = F.col(url_col).cast("string")
    _, verdict = matched_rule(host_of(url), path_of(url), rules)
    return urls.select(url.alias("url"), (verdict == BLOCK).alias("blocked")).where(F.col("blocked").isNotNull())
