"""Secret scans: candidates by shape, judged by a random forest in column expressions.

A candidate is, in a word (text without white space), each run of at least
``MIN_LENGTH`` characters that keys are made of, or of any characters in quotes,
which either mixes letters and digits or is the value of a naming word (``secret =
...``), as pass phrases have no digit. Its features are length, character
transitions, dictionary coverage, signs of a path, and neighbouring words.
The dictionary is a fixed list and the corpus' own common words, counted over all
documents. A random forest is fitted on the driver to at most ``MAX_LABELLED``
labelled findings and then written as nested ``when`` expressions, so that a scan is
one narrow projection inside the JVM: no Python, and no row of text leaves its task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH = 12
MAX_LABELLED = 4000
TREES, DEPTH, LEAST_LEAF = 15, 6, 4
THRESHOLD = 0.5
MARK = "[secret]"
#: How many of the corpus' commonest words, of how many letters, join the dictionary.
CORPUS_WORDS, WORD_LETTERS = 1000, (4, 14)
#: Words (fixed values) whose presence in a candidate speaks for prose, names or code.
DICTIONARY = (
    "about access account admin after agent alert alpha apache archive array asset author backup banner basic batch beta binary block branch browser buffer build bundle "
    "button cache change channel check client cloud cluster code column comment commit common config console content context control copy core count create customer data "
    "database date debug default demo deploy design detail develop device digest direct docs document domain download draft driver dummy edit email enable engine entry error event "
    "example export extra feature field file filter final first fixture folder format frame from gateway global group handler header health hello helper home host http image import "
    "index info init input install item java job json kernel label language latest layer layout level library license light line link list local lock login logo machine mail main "
    "manager market master media memory message method metric middle mobile mock model module monitor name network news node note number object order output package page panel "
    "parent part patch path phone photo picture placeholder platform plugin point policy portal post print process product profile project proxy public query queue read region release "
    "remote report request resource response result review role root route sample schema script search section server service session setting shard sheet simple site size snapshot "
    "source stage start state static status storage store stream string style submit summary support switch system table task team template test text theme thread time title total "
    "trace track train type unit update upload user utils value version video view volume with word work world"
).split()
_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|ed|is|it|al|ar|st|to|nt|ng|se|ha|ou|le|io|de|ra|ie|ei|ch|qu|un|la|el"
_FOR = "(?i)(?:key|token|secret|passw|pwd|auth|credential|bearer|private|signature)"
_AGAINST = "(?i)sha[0-9]|commit|hash|md5|checksum|uuid|guid|version|revision|digest|build|etag|example|sample|dummy|placeholder|request|trace|order|license|mail|http|page"
FEATURES = (
    "length transitions digits uppers distinct dictionary pairs slashes dots joints at_sign test_path word_for word_against assigned quoted hex uuid_form".split()
)


def common_words(docs: DataFrame, most: int = CORPUS_WORDS) -> list[str]:
    """The words that most documents hold, of those in two or more; counted over all rows, summed before the shuffle."""
    low, high = WORD_LETTERS
    found = F.array_distinct(F.filter(F.split(F.lower(F.col("text")), "[^\\p{L}]+"), lambda w: F.length(w).between(low, high)))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def _features(x: Column, path: Column, dictionary: list[str]) -> list[Column]:
    """Features of a finding; x has finding, near (words before it and the rest of its own) and quote."""
    c, near, n = x["finding"], x["near"], F.length(x["finding"]).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    return [
        n,
        share("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"),
        share("[0-9]"),
        share("[A-Z]"),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        (n - F.length(F.regexp_replace(F.lower(c), "|".join(sorted(dictionary, key=lambda w: (-len(w), w))), ""))) / n,
        F.regexp_count(F.lower(c), F.lit(_PAIRS)) / n,
        share("/"),
        share("[.]"),
        share("[_-]|[a-z](?=[A-Z][a-z])"),
        flag(F.contains(c, F.lit("@"))),
        flag(F.lower(path).rlike("test|example|fixture|sample|mock|docs?/")),
        flag(near.rlike(_FOR)),
        flag(near.rlike(_AGAINST)),
        flag(near.rlike(_NAMES)),
        flag(x["quote"]),
        flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        flag(c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
    ]


_OF = "A-Za-z0-9+/_.~@\\-"
#: What stands in quotes and holds no sign of a list, a pair or markup; else a run of a key's signs, with padding that no value follows.
_SHAPE = f"(?<=[\"'])[^\"'\\s=:,;{{}}\\[\\]<>&]{{{MIN_LENGTH},}}+(?=[\"'])|(?<![{_OF}])[{_OF}]++(?:={{1,2}}(?![{_OF}\"'=]))?"
#: Characters of a word that are read before a run as its name, and of the words before it.
NEAR_CHARS = 200
_NAMES = "[=:]\\s*[\"']?\\s*$"
#: A naming word right before the sign that gives a value its name.
_NAMED = f"(?:{_FOR}[{_OF}]*[\"'\\])]*\\s*:?[=:]>?|(?i)bearer)\\s*[\"'`]?\\s*$"


def _runs(word: Column, before: Column) -> Column:
    """array<struct<finding, near, quote>> of all runs of a word that may be keys.

    A run's near is the text between it and the candidate before it in the word.
    Where that has no letter, it is the text before the one before, as of keys in
    a list, or that candidate itself where it names this one.
    """
    nothing = F.from_json(F.lit("[]"), "array<struct<finding:string,near:string,quote:boolean>>")
    start = F.struct(before.alias("near"), F.lit("").alias("last"), F.lit("").alias("open"), nothing.alias("found"))
    gaps, runs = F.regexp_extract_all(word, F.lit(f"(?s)(.*?)({_SHAPE})"), F.lit(1)), F.regexp_extract_all(word, F.lit(f"(?s)(.*?)({_SHAPE})"), F.lit(2))

    def step(state: Column, x: Column) -> Column:
        own = F.concat(state["open"], x["gap"])
        named = F.concat(state["last"], own)
        first = F.size(state["found"]) == 0
        near = F.when(first, F.concat(state["near"], F.lit(" "), own)).when(own.rlike("\\p{L}"), own).when(named.rlike(_NAMES), named).otherwise(F.concat(state["near"], own))
        near = F.right(near, F.lit(2 * NEAR_CHARS))
        one = F.struct(x["run"].alias("finding"), near.alias("near"), own.rlike("[\"'`]$").alias("quote"))
        mixed = x["run"].rlike("[A-Za-z]") & x["run"].rlike("[0-9]")
        fit = (F.length(x["run"]) >= MIN_LENGTH) & (mixed | near.rlike(_NAMED))
        taken = F.struct(near.alias("near"), x["run"].alias("last"), F.lit("").alias("open"), F.concat(state["found"], F.array(one)).alias("found"))
        passed = F.struct(state["near"].alias("near"), state["last"].alias("last"), F.right(F.concat(own, x["run"]), F.lit(NEAR_CHARS)).alias("open"), state["found"].alias("found"))
        return F.when(fit, taken).otherwise(passed)

    return F.aggregate(F.zip_with(gaps, runs, lambda g, r: F.struct(g.alias("gap"), r.alias("run"))), start, step, lambda state: state["found"])


def _candidates(text: Column) -> Column:
    """array<struct<place, finding, near, quote>> of a text; place is the word's number, which all its findings have."""
    parts = F.split(text, "\\s+")
    numbered = F.transform(parts, lambda w, i: F.struct(i.alias("place"), w.alias("word")))
    mixed = lambda w: w.rlike("[0-9]") & w.rlike("[A-Za-z]")
    valued = lambda x: x["word"].rlike("[=:]") | F.when(x["place"] > 0, F.get(parts, x["place"] - 1).rlike("[=:]>?[\"'`]?$|(?i)bearer$")).otherwise(F.lit(False))
    fit = F.filter(numbered, lambda x: (F.length(x["word"]) >= MIN_LENGTH) & (mixed(x["word"]) | valued(x)))

    def before(x: Column) -> Column:
        begin = F.greatest(x["place"] - 3, F.lit(0))
        return F.right(F.array_join(F.slice(parts, begin + 1, x["place"] - begin), " "), F.lit(NEAR_CHARS))

    def of_word(x: Column) -> Column:
        return F.transform(_runs(x["word"], before(x)), lambda r: F.struct(x["place"].alias("place"), r["finding"].alias("finding"), r["near"].alias("near"), r["quote"].alias("quote")))

    return F.flatten(F.transform(fit, of_word))


@dataclass
class Leaf:
    share: float


@dataclass
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> Leaf | Split:
    if depth == 0 or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return Leaf(float(y.mean()))
    best = (np.inf, 0, 0.0)
    for k in rng.permutation(x.shape[1])[: max(1, round(x.shape[1] ** 0.5))]:
        order = np.argsort(x[:, k], kind="stable")
        v, ones = x[order, k], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        places = np.flatnonzero((v[1:] > v[:-1]) & (n[:-1] >= LEAST_LEAF) & (len(y) - n[:-1] >= LEAST_LEAF))
        if not len(places):
            continue
        low, high = ones[places] / n[places], (ones[-1] - ones[places]) / (len(y) - n[places])
        gini = n[places] * low * (1 - low) + (len(y) - n[places]) * high * (1 - high)
        j = int(gini.argmin())
        if gini[j] < best[0]:
            best = (gini[j], int(k), float((v[places[j]] + v[places[j] + 1]) / 2))
    if best[0] == np.inf:
        return Leaf(float(y.mean()))
    low = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], _grow(x[low], y[low], depth - 1, rng), _grow(x[~low], y[~low], depth - 1, rng))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Leaf | Split]:
    """A random forest: bootstrap rows, a random part of the features at each split."""
    rng = np.random.default_rng(17)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        forest.append(_grow(x[rows], y[rows], depth, rng))
    return forest


def _as_column(tree: Leaf | Split, features: Column) -> Column:
    if isinstance(tree, Leaf):
        return F.lit(tree.share)
    return F.when(features[f"f{tree.feature}"] <= F.lit(tree.at), _as_column(tree.low, features)).otherwise(_as_column(tree.high, features))


def labelled_findings(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Made findings with labels: path, text (whose last candidate is meant), label.

    A stand-in for findings that reviewers have labelled. True ones are random
    keys of several alphabets, passwords with signs and pass phrases behind a
    naming word; false ones are digests of files and commits, identifiers, versions,
    addresses, paths, codes, names of code and placeholders, half of them behind a
    naming word too. Both have the same paths, quotes, signs and leads; test paths
    are only commoner among false ones.
    """
    pick = lambda salt, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    noise = lambda salt: F.sha2(F.concat_ws("-", "id", F.lit(salt)), 512)
    base64 = lambda salt: F.regexp_replace(F.base64(F.unhex(noise(salt))), "[\\r\\n=]", "")
    size = lambda salt, low, high: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")
    cut = lambda text, length: text.substr(F.lit(1), length)
    word = lambda salt: pick(salt, *DICTIONARY[::3])
    kind = lambda salt, most: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most))

    def choose(salt: str, *texts: Column) -> Column:
        chosen = texts[-1]
        for k, text in enumerate(texts[:-1]):
            chosen = F.when(kind(salt, len(texts)) == k, text).otherwise(chosen)
        return chosen

    name = pick("name", "token", "api_key", "secret", "password", "auth_token", "private_key", "access_key", "client_secret", "db_passwd", "credential")
    sign, quote = pick("sign", " = ", ": ", "=", " := ", ":"), pick("quote", '"', "'", "", '"')
    lead = pick("lead", "", "the ", "export ", "set the ", "const ", "see ")
    named = lambda value: F.concat(lead, name, sign, quote, value, quote)
    quoted = lambda value: F.concat(lead, name, sign, F.lit('"'), value, F.lit('"'))
    plain = F.regexp_replace(base64("c"), "[+/]", "x")
    pairs = F.array(*map(F.lit, _PAIRS.split("|")))
    spoken = F.array_join(F.transform(F.sequence(F.lit(1), size("p6", 7, 13)), lambda i: F.get(pairs, F.pmod(F.xxhash64("id", i), F.size(pairs)).cast("int"))), "")
    phrase = F.when(kind("p7", 3) > 0, spoken).otherwise(F.concat(word("p1"), word("p2"), word("p3"), F.when(kind("p5", 2) == 0, word("p4")).otherwise(F.lit(""))))
    true_text = choose(
        "true",
        named(cut(noise("a"), size("s1", 32, 64))),
        named(cut(base64("b"), size("s2", 24, 64))),
        named(F.concat(pick("prefix", "AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-"), cut(plain, size("s3", 16, 40)))),
        named(cut(base64("d"), size("s4", 12, 24))),
        named(F.upper(cut(noise("e"), size("s5", 20, 40)))),
        quoted(F.concat(cut(plain, size("s6", 6, 10)), pick("odd", "!", "$", "#", "%", "*"), cut(base64("g"), size("s7", 6, 10)))),
        quoted(phrase),
        F.concat(lead, pick("url", "https://host.example/x?token=", "postgres://svc:", "Authorization: Bearer "), cut(plain, size("s8", 20, 40))),
    )
    uuid = F.regexp_replace(cut(noise("u"), F.lit(32)), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    number = lambda salt, most: kind(salt, most).cast("string")
    snake = F.concat_ws("_", word("w1"), word("w2"), word("w3"))
    camel = F.concat(word("w1"), F.initcap(word("w2")), F.initcap(word("w3")))
    about = lambda salt, *xs: F.concat(pick(salt, *xs), quote)
    false_text = choose(
        "false",
        F.concat(lead, about("of", "commit ", "sha256: ", "md5 checksum ", "revision ", "digest: ", "etag="), cut(noise("f"), pick("len", 32, 40, 64)), quote),
        F.concat(lead, about("uid", "uuid ", "request id ", "trace: ", "guid = "), uuid, quote),
        F.concat(lead, snake, F.lit("_v"), number("n1", 30)),
        F.concat(F.lit("mail to "), word("w4"), F.lit("."), number("n2", 97), F.lit("@mail"), number("n3", 9), F.lit(".example.com")),
        F.concat(lead, word("w5"), F.lit("/"), word("w6"), F.lit("/"), word("w7"), number("n4", 50), F.lit(".json")),
        named(F.concat(word("w8"), F.lit("-"), word("w9"), pick("mid", "-example-", "-sample-", "-test-"), number("n5", 1000))),
        F.concat(lead, F.lit("version "), number("n6", 20), F.lit("."), number("n7", 13), F.lit(".0-"), word("w10"), F.lit("-build"), number("n8", 5000)),
        named(F.concat(pick("filler", "xxxxxxxxxxxxxxxx", "00000000aaaa0000", "****************", "1234567890abcdef"), number("n9", 7))),
        F.concat(lead, F.lit("order number "), F.upper(word("w11")), F.lit("-2024-"), number("n10", 9000), F.lit("-A")),
        named(F.concat(pick("your", "your_", "my_", "insert_"), word("w12"), F.lit("_key_here_"), number("n11", 100))),
        named(snake),
        named(F.concat(camel, F.lit("."), word("w13"))),
        F.concat(lead, name, pick("colon", ": ", " = "), spoken),
        named(F.concat(F.lit("config/"), word("w14"), F.lit("/"), word("w15"), F.lit(".pem"))),
    )
    true_row = kind("label", 2) == 0
    tests = F.when(true_row, kind("where", 4) == 0).otherwise(kind("where", 2) == 0)
    path = F.when(tests, pick("path", "tests/fixtures/data.json", "docs/readme.md", "examples/run.sh")).otherwise(pick("path2", "src/app.py", "", "config/prod.env", "src0"))
    return spark.range(n).select(path.alias("path"), F.when(true_row, true_text).otherwise(false_text).alias("text"), true_row.cast("double").alias("label"))


@dataclass
class Model:
    """A forest, and the dictionary that its features read."""

    trees: list[Leaf | Split]
    dictionary: list[str]


def train(labelled: DataFrame, words: list[str] | tuple = (), max_labelled: int = MAX_LABELLED) -> Model:
    """A model for labelled findings (path, text, label) with ``words`` besides the fixed dictionary.

    Of more labelled findings than the bound, those with the least hash of text.
    """
    dictionary = sorted({*DICTIONARY, *words})
    found = labelled.withColumn("x", F.try_element_at(_candidates(F.col("text")), F.lit(-1))).where(F.col("x").isNotNull())
    rows = found.select(*[f.cast("double").alias(f"f{k}") for k, f in enumerate(_features(F.col("x"), F.coalesce("path", F.lit("")), dictionary))], "label", F.xxhash64("text").alias("h"))
    rows = rows.orderBy("h", *[f"f{k}" for k in range(len(FEATURES))], "label").limit(max_labelled).drop("h").collect()
    if not rows:
        return Model([Leaf(0.0)], dictionary)
    table = np.array([tuple(r) for r in rows])
    return Model(fit(table[:, :-1], table[:, -1]), dictionary)


def default_model(docs: DataFrame) -> Model:
    """A model of the made findings and the corpus' common words."""
    return train(labelled_findings(docs.sparkSession), common_words(docs))


def findings_of(text: Column, path: Column, model: Model) -> Column:
    """array<struct<place, finding, probability, secret>> of a text."""
    found = F.when(text.rlike("[0-9=:]"), _candidates(text))
    featured = F.transform(found, lambda x: F.struct(x["place"].alias("place"), x["finding"].alias("finding"), *[f.cast("double").alias(f"f{k}") for k, f in enumerate(_features(x, path, model.dictionary))]))

    def judged(x: Column) -> Column:
        votes = reduce(lambda a, b: a + b, [_as_column(t, x) for t in model.trees])
        return F.struct(x["place"].alias("place"), x["finding"].alias("finding"), F.round(votes / len(model.trees), 6).alias("probability"))

    scored = F.transform(featured, judged)
    return F.transform(scored, lambda x: F.struct(x["place"], x["finding"], x["probability"], (x["probability"] >= THRESHOLD).alias("secret")))


def _path(docs: DataFrame) -> Column:
    """Where a text comes from: path or url, else source."""
    known = next((c for c in ("path", "url", "source") if c in docs.columns), None)
    return F.coalesce(F.col(known).cast("string"), F.lit("")) if known else F.lit("")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Each candidate with its probability: doc_id, place, finding, probability, secret.

    docs: doc_id, text and, as a path, path, url or source; other columns are
    left out. place is the number of the word that holds the finding. Null,
    empty and blank texts have no candidates. Repeated rows give their findings
    each. Texts of any length are taken whole; an empty table gives no rows.
    """
    model = model or default_model(docs)
    found = docs.select("doc_id", F.explode(findings_of(F.col("text"), _path(docs), model)).alias("x"))
    return found.select("doc_id", F.col("x.place").cast("long").alias("place"), F.col("x.finding").alias("finding"), F.col("x.probability").alias("probability"), F.col("x.secret").alias("secret"))


def redact(docs: DataFrame, model: Model | None = None, mark: str = MARK) -> DataFrame:
    """docs with each secret in ``text`` replaced by a mark, wherever it stands in its text.

    All rows and columns stay; a null or empty text stays as it is, repeated
    rows are cleaned each by itself, texts of any length are taken whole, and an
    empty table stays empty. Other columns' names don't matter.
    """
    model = model or default_model(docs)
    secrets = F.filter(findings_of(F.col("text"), _path(docs), model), lambda x: x["secret"])
    # longer ones first, so that one that holds another goes as a whole
    ordered = F.array_sort(F.array_distinct(F.transform(secrets, lambda x: F.struct((-F.length(x["finding"])).alias("n"), x["finding"].alias("finding")))))
    cleaned = F.aggregate(ordered, F.col("text"), lambda text, x: F.replace(text, x["finding"], F.lit(mark)))
    return docs.withColumn("text", F.coalesce(cleaned, F.col("text")))
