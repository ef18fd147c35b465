"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Shallow trees grown on labelled documents give rules: the conjunction of the tests on the way to each of their nodes.
A logistic regression with lasso penalty over the rules keeps a few of them, and their weighted sum is one column
expression over the statistics, so that scoring needs no Python. Learned from a bounded sample: the SAMPLE labelled documents (crc32
of the id no multiple of 5) with the smallest id hashes.

Cases: null text counts as empty, and an empty text has statistics 0 and a score as any other; equal texts have equal
scores; with labels of one kind only the score is that label, and 0.5 without labels; an id with several labels is
learned once for each, and rows with one id each count; null ids are scored as others and never learned from; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.llm.common import held_out, in_training, stored

SAMPLE, TREES, DEPTH, PENALTY, ROUNDED = 10_000, 8, 3, 0.002, 6
Rule = tuple[tuple[int, str, float], ...]  # (statistic, "<=" or ">", threshold), all of them


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0)), ROUNDED)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once a row."""
    return F.transform(F.array(value), body)[0]


def statistics(text: Column) -> Column:
    """struct of the statistics (NAMES) of a whole text.

    Characters are counted by what is left of a text without them; digits and signs on what is left without letters.
    """
    left = lambda c, pattern: F.regexp_replace(c, pattern, "")
    parts = _let(F.coalesce(text, F.lit("")), lambda t: F.struct(
        F.length(t).alias("chars"), left(t, r"\p{L}+").alias("rest"), F.length(left(t, r"\P{Lu}+")).alias("upper"),
        F.split(t, r"\s+").alias("words"), F.filter(F.split(t, "\n"), lambda x: x != "").alias("lines"),
    ))

    def described(p: Column) -> Column:
        rest, chars, words, lines = p["rest"], p["chars"], p["words"], p["lines"]
        letters = chars - F.length(rest)
        count = lambda pattern: F.length(rest) - F.length(left(rest, pattern))
        values = {
            "chars": chars.cast("double"),
            "letters": _share(letters, chars),
            "upper": _share(p["upper"], letters),
            "digits": _share(count("[0-9]+"), chars),
            "signs": _share(count(r"[^\p{N}\s.,;:'’\"()!?-]+"), chars),
            "shouts": _share(count("[!?]+"), chars),
            "stops": _share(count("[.,;:]+"), chars),
            "word_length": _share(chars, F.size(words)),
            "repeated_words": F.round(1 - _share(F.size(F.array_distinct(words)), F.size(words)), ROUNDED),
            "repeated_lines": F.round(1 - _share(F.size(F.array_distinct(lines)), F.size(lines)), ROUNDED),
            "line_length": _share(chars, F.size(lines)),
        }
        return F.struct(*(values[n].alias(n) for n in NAMES))

    return _let(parts, described)


NAMES = ["chars", "letters", "upper", "digits", "signs", "shouts", "stops", "word_length", "repeated_words", "repeated_lines", "line_length"]


def rules_of(model) -> list[Rule]:
    """The way to every node but the roots, as tests on statistics; each rule once."""
    found: dict[Rule, None] = {}

    def walk(node, way: Rule) -> None:
        if way:
            found.setdefault(way)
        if node.subtreeDepth() > 0:
            split = node.split()
            k, x = split.featureIndex(), float(split.threshold())
            walk(node.leftChild(), (*way, (k, "<=", x)))
            walk(node.rightChild(), (*way, (k, ">", x)))

    for tree in model.trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def holds(rule: Rule, stats: Column) -> Column:
    out = F.lit(True)
    for k, sign, x in rule:
        column = stats[NAMES[k]]
        out = out & ((column <= x) if sign == "<=" else (column > x))
    return out


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label and statistics of the labelled documents to learn from, stored; at most SAMPLE labels."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("label")).distinct()
    picked = known.where(in_training("id")).orderBy(F.xxhash64("id"), "id", "label").limit(SAMPLE)
    texts = docs.select("doc_id", "text")
    found = texts.join(F.broadcast(picked), texts["doc_id"] == picked["id"]).select("doc_id", "label", statistics(F.col("text")).alias("stats"))
    return stored(found.orderBy("doc_id", "label", "stats").coalesce(1), "quality-sample")


def grown(rows: DataFrame, n: int, good: float):
    """A forest of shallow trees over the statistics, both labels weighing the same."""
    weighted = rows.select("label", "stats.*", F.when(F.col("label") == 0, n / (2.0 * (n - good))).otherwise(n / (2.0 * good)).alias("weight"))
    vectors = VectorAssembler(inputCols=NAMES, outputCol="features").transform(weighted).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=7, weightCol="weight", featureSubsetStrategy="onethird").fit(vectors)
    vectors.unpersist()
    return forest


def weighed(rows: DataFrame, rules: list[Rule]) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and lasso weights of the rules, those of no weight left out."""
    names = [f"r{k}" for k in range(len(rules))]
    hits = rows.select("label", *(holds(r, F.col("stats")).cast("double").alias(x) for r, x in zip(rules, names, strict=True)))
    assembled = VectorAssembler(inputCols=names, outputCol="features").transform(hits).select("label", "features").cache()
    fit = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(assembled)
    assembled.unpersist()
    kept = [(round(float(w), 6), r) for w, r in zip(fit.coefficients.toArray(), rules, strict=True) if abs(w) > 1e-4]
    return round(float(fit.intercept), 6), kept


def learn(docs: DataFrame, labels: DataFrame) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules."""
    rows = sample(docs, labels)
    n, good = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or good in (0, n):
        return (0.0 if not n else 30.0 if good else -30.0), []
    return weighed(rows, rules_of(grown(rows, n, good)))


def compiled(learned: tuple[float, list[tuple[float, Rule]]], stats: Column) -> Column:
    """The score as a column expression over a struct of statistics."""
    total = F.lit(learned[0])
    for weight, rule in learned[1]:
        total = total + F.when(holds(rule, stats), weight).otherwise(0.0)
    return F.round(1 / (1 + F.exp(-total)), 9)


def score(text: Column, learned: tuple[float, list[tuple[float, Rule]]]) -> Column:
    """The score of a text. The statistics are bound inside the expression, so that they are computed once wherever
    it stands."""
    return _let(statistics(text), lambda stats: compiled(learned, stats))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = docs.select("doc_id", score(F.col("text"), learn(docs, labels)).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def kept(docs: DataFrame, learned: tuple[float, list[tuple[float, Rule]]], least: float = 0.3) -> DataFrame:
    """The rows scored at least so much, all their columns as they are."""
    return docs.where(score(F.col("text"), learned) >= least)
