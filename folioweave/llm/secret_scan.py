"""Operator 7, secret scans: candidates by pattern, false positives removed by a random forest.

Scanning uses DataFrame functions alone: the forest is grown once, on the driver, from the labelled
findings below, and travels as arrays in a constant.
"""

from __future__ import annotations

import base64
import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, table

#: Shortest candidate anywhere, and after the name of a secret; characters before and after it that count as its neighbourhood; score from which it is a secret.
LEAST, NAMED_LEAST, BEFORE, AFTER, THRESHOLD = 16, 6, 48, 16, 0.5
CHARS = "A-Za-z0-9+/_=.\\-"
SECRET_WORDS = "key|token|secret|passw|passphrase|pwd|auth|credential|bearer|private|signature|apikey"
#: What ends where the value of a secret's name begins: ``api_key=``, ``"password": "``, ``Bearer ``.
ASSIGNED = f"(?i:{SECRET_WORDS})[A-Za-z0-9_]{{0,12}}[\"'`]?\\s{{0,2}}[=:]\\s{{0,2}}[\"'`]?"
NAMED = f"(?<=[=:\\s\"'`])(?:(?<=[=:][\\s\"'`]{{0,3}})(?<={ASSIGNED})|(?<=(?i:bearer)\\s))(?!\\[SECRET\\])[^\\s\"'`,;]{{{NAMED_LEAST},}}+"
#: A run of CHARS; of ``name=value`` the value alone.
RUN = f"(?:(?<![{CHARS}])|(?<=[A-Za-z0-9_.\\-]=))(?![A-Za-z_][A-Za-z0-9_.\\-]*=[{CHARS}]{{{NAMED_LEAST}}})[{CHARS}]{{{LEAST},}}+"
CANDIDATE = f"{NAMED}|{RUN}"
#: A text without either has no candidate.
GATES = (f"[{CHARS}]{{{LEAST}}}", f"(?i)(?:{SECRET_WORDS})[a-z0-9_]{{0,12}}[\"'`]?(?:\\s{{0,2}}[=:]|\\s)")
#: Runs that stand after no name are candidates if they have one of these.
MIXED = "[0-9]|[a-z][A-Z]"
TREES, DEPTH, LEAF, FINDINGS, SEED = 25, 7, 3, 3200, 11
REDACTED = "[SECRET]"

DICTIONARY = (
    "about access account action address admin after alpha application archive array assets async backup banner base batch binary block body book branch build button cache call camel case chain chapter check "
    "class client cloud code collection column com common community compile complete component config connection console container content context control core count create css current dashboard data database date "
    "debug default delete deploy description design detail developer device dialog dictionary digest directory dist docs document domain download editor element email engine entry environment error event example "
    "export factory feature field file filter final folder font footer form format forum found frame framework from function gallery general generate global graph group handler header height hello home host html http "
    "https icon image images implementation import include index info input install instance integration interface internal java javascript json kernel label language layout length level library license line link list "
    "local location login long main manager map master max media member memory menu merge message method min mobile model module monitor name network news node note number object open operator option order org output "
    "package page panel parent parser path payload photo picture plugin point policy post power preview print private process product profile program project property provider public query queue random range read "
    "record release remote report repository request resource response result return review root route rule sample schema screen script search second section select server service session setting shared simple site "
    "size snapshot source spec stack static status storage store stream string style submit super support system table target task team template test text the this thread time title token tools topic track transaction "
    "type unit update upload user users utils value variable vector vendor version video view virtual web widget width window with word work worker wrapper write www year zone"
).split()
PLAIN_WORDS = "sha|md5|checksum|commit|digest|hash|uuid|guid|revision|etag|version|image|path|file|import|class|href|src|build|integrity|isbn|blob"
#: The features, in this order.
NAMES = ("length", "case_steps", "vowel_steps", "digits", "uppers", "distinct", "hex", "coverage", "slashes", "dots", "joints", "extension", "secret_word", "plain_word", "assigned", "quoted", "symbols", "run")


def feature_columns(c: Column, before: Column, after: Column) -> list[Column]:
    """Doubles: length, transitions between kinds of characters, dictionary coverage, path and neighbouring words."""
    n = F.length(c).cast("double")
    low, near = F.lower(c), F.lower(before)
    share = lambda pattern, x=c: F.regexp_count(x, F.lit(pattern)) / n
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    longest_first = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    return [
        n,
        share("[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])"),
        share("[aeiou](?=[bcdfghjklmnpqrstvwxz])|[bcdfghjklmnpqrstvwxz](?=[aeiou])", low),
        share("[0-9]"),
        share("[A-Z]"),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        share("[0-9a-f]", low),
        (n - F.length(F.regexp_replace(low, longest_first, ""))) / n,
        share("/"),
        share("[.]"),
        share("[-_]"),
        flag(c.rlike("[.][a-z][a-z0-9]{0,4}$")),
        flag(near.rlike(SECRET_WORDS)),
        flag(near.rlike(f"(^|[^a-z])({PLAIN_WORDS})")),
        flag(near.rlike("[=:]\\s*[\"'`]?$")),
        flag(near.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        share("[^A-Za-z0-9]"),
        F.regexp_count(c, F.lit("(.)\\1\\1")) / n,
    ]


def labelled_findings(count: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(candidate, text before, text after, label): findings as reviewers mark them, half of them secrets."""
    rng = random.Random(seed)
    some = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    alnum, hexes, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    word = lambda: rng.choice(DICTIONARY)
    prose = lambda: " ".join(word() for _ in range(rng.randint(0, 5)))
    quote = lambda: rng.choice(["", '"', "'", '"'])
    opens = ["token", "api_key", "API_KEY", "secret", "password", "passwd", "aws_secret_access_key", "auth_token", "Authorization: Bearer", "private_key", "access_token", "client_secret", "pwd"]
    benign = ["commit", "sha256", "md5", "checksum", "digest", "etag", "uuid", "build", "image", "revision", "hash", "integrity", "version", "blob"]
    found = []
    for k in range(count):
        q = quote()
        if k % 8 == 6:  # passwords and short keys, with any characters, after the name of a secret
            body = rng.choice([
                lambda: some(alnum, 8, 15), lambda: some(alnum + "!@#$%^&*?", 8, 16), lambda: word().title() + str(rng.randint(10, 9999)) + rng.choice("!@#$%&*?") + some(alnum, 0, 4), lambda: some(string.ascii_letters, 12, 32),
                lambda: some("abcdefghijklmnopqrstuvwxyz", 3, 6) + str(rng.randint(10, 999)) + rng.choice(["!", "$", "x", "Q#"]) + some(alnum, 2, 5), lambda: "$".join(some(alnum, 3, 6) for _ in range(3)), lambda: some(string.ascii_lowercase, 16, 24),
            ])()
            found.append((body, f"{prose()} {rng.choice(opens)}{rng.choice([' = ', '=', ': '])}{q}"[-BEFORE:], q + " " + prose()[:8], 1))
        elif k % 8 == 7:  # what stands after such names without being a secret
            body = rng.choice([
                lambda: word(), lambda: word() + "_" + word(), lambda: "".join(some("bcdfghlmnprstvw", 1, 2) + some("aeiou", 1, 1) for _ in range(rng.randint(3, 6))), lambda: f"your_{word()}_here", lambda: "${" + word().upper() + "_" + word().upper() + "}", lambda: "<" + word() + "-" + word() + ">", lambda: rng.choice("x*.-0") * rng.randint(6, 20),
                lambda: rng.choice(["changeme", "example", "required", "undefined", "placeholder", "REDACTED", "[SECRET]", "missing", "optional", "string"]), lambda: "process.env." + word().upper(), lambda: "os.environ[" + word().upper() + "]",
                lambda: word() + "." + word() + "()", lambda: word().title() + word().title(), lambda: "https://" + word() + ".com/" + word(), lambda: "/" + word() + "/" + word() + "/" + word() + ".pem", lambda: word() + "-" + word() + "-" + word(),
            ])()
            found.append((body if len(body) >= NAMED_LEAST else body + "_" + word(), f"{prose()} {rng.choice(opens)}{rng.choice([' = ', '=', ': '])}{q}"[-BEFORE:], q + " " + prose()[:8], 0))
        elif k % 2 == 0:
            body = rng.choice([
                lambda: some(hexes, 32, 64), lambda: some(hexes, 40, 40), lambda: some(hexes.upper(), 32, 40), lambda: some(alnum, 20, 48), lambda: some(b64, 24, 64) + rng.choice(["", "=", "=="]),
                lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16, 16), lambda: "ghp_" + some(alnum, 36, 36), lambda: "sk_live_" + some(alnum, 24, 32), lambda: "xoxb-" + some(string.digits, 11, 12) + "-" + some(alnum, 24, 24),
                lambda: "eyJ" + some(alnum, 20, 40) + "." + some(alnum, 40, 80) + "." + some(alnum + "_-", 30, 43), lambda: "AIza" + some(alnum + "_-", 35, 35),
            ])()
            known = body.startswith(("AKIA", "ghp_", "sk_", "xox", "eyJ", "AIza"))
            lead = f"{prose()} {rng.choice(opens)}{rng.choice([' = ', '=', ': ', ' '])}{q}" if not known or rng.random() < 0.6 else f"{prose()} {q}"
            found.append((body, lead[-BEFORE:], q + " " + prose()[:8], 1))
        else:
            body = rng.choice([
                lambda: "/".join(word() for _ in range(rng.randint(3, 7))) + f"/{word()}{rng.randint(0, 99)}." + rng.choice(["js", "py", "html", "png", "java", "css", "txt"]),
                lambda: ".".join(word() for _ in range(rng.randint(4, 7))) + str(rng.randint(0, 9)), lambda: "".join(word().title() for _ in range(rng.randint(3, 6))) + str(rng.randint(0, 99)),
                lambda: "_".join(word() for _ in range(rng.randint(3, 6))) + f"_{rng.randint(0, 2030)}", lambda: "-".join(word() for _ in range(rng.randint(3, 7))) + f"-{rng.randint(1, 99)}",
                lambda: some(hexes, 32, 64), lambda: some(hexes, 40, 40), lambda: "-".join(some(hexes, n, n) for n in (8, 4, 4, 4, 12)), lambda: rng.choice("=-_.") * rng.randint(20, 60) + str(rng.randint(0, 9)),
                lambda: some(string.digits, 20, 40), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}-" + word() + "-" + word(), lambda: rng.choice("0123456789ax") * rng.randint(20, 50) + "0",
                lambda: "https.example.org/" + base64.b16encode(word().encode()).decode().lower() + "/" + word() + "/" + word() + "1", lambda: word() * rng.randint(4, 8) + str(rng.randint(0, 9)), lambda: "0x" + some(hexes, 20, 40),
            ])()
            random_like = not any(len(w) > 3 and w in body.lower() for w in DICTIONARY) and len(set(body)) > 8 and not body.isdigit()
            lead = f"{prose()} {rng.choice(benign)}{rng.choice([' = ', '=', ': ', ' '])}{q}" if random_like else f"{prose()} {rng.choice(['', '', 'see ', 'path: ', 'name = ', 'token = ', 'key: '])}{q}"
            body = body if len(body) >= LEAST else body + "/" + word() * 5 + "0"
            found.append((body, lead[-BEFORE:], q + " " + prose()[:8], 0))
    return found


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree as nested (feature, threshold, left, right), leaves as probabilities; splits by Gini over a random third of the features."""
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    best = (1e-9, None)
    whole = len(y) * (p := y.mean()) * (1 - p)
    for j in rng.choice(x.shape[1], max(2, x.shape[1] // 3), replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], y[order].cumsum()
        n = np.arange(1, len(y) + 1)
        ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= LEAF) & (n[:-1] <= len(y) - LEAF))
        if not len(ok):
            continue
        a, na = t[ok], n[ok]
        b, nb = t[-1] - a, len(y) - na
        gain = whole - a * (1 - a / na) - b * (1 - b / nb)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], (int(j), float((v[ok[k]] + v[ok[k] + 1]) / 2)))
    if best[1] is None:
        return float((y.sum() + 0.5) / (len(y) + 1))
    j, cut = best[1]
    left = x[:, j] <= cut
    return (j, cut, _grow(x[left], y[left], rng, depth - 1), _grow(x[~left], y[~left], rng, depth - 1))


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> list:
    rng = np.random.default_rng(seed)
    return [_grow(x[at := rng.integers(0, len(y), len(y))], y[at], rng, DEPTH) for _ in range(trees)]


def _full(tree) -> dict[str, list]:
    """A tree as arrays: features and thresholds of a full binary tree in breadth-first order, and its leaves."""
    level, f, t = [tree], [], []
    for _ in range(DEPTH):
        f += [0 if isinstance(x, float) else x[0] for x in level]
        t += [1e300 if isinstance(x, float) else x[1] for x in level]
        level = [y for x in level for y in ((x, x) if isinstance(x, float) else x[2:])]
    return {"f": f, "t": t, "leaf": [round(x, 6) for x in level]}


def forest_column(forest: list, x: Column) -> Column:
    """The mean of the trees' probabilities for the array of features ``x``: DEPTH comparisons down each tree."""
    trees = F.from_json(F.lit(json.dumps([_full(t) for t in forest])), "array<struct<f:array<int>,t:array<double>,leaf:array<double>>>")
    down = lambda tree: F.aggregate(
        F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), lambda at, _: 2 * at + 1 + F.when(x[tree["f"][at]] <= tree["t"][at], 0).otherwise(1)
    )
    return F.aggregate(trees, F.lit(0.0), lambda a, tree: a + tree["leaf"][down(tree) - (2**DEPTH - 1)]) / len(forest)


_forests: dict[str, list] = {}


def _grown(spark: SparkSession) -> list:
    rows = labelled_findings()
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, c string, b string, a string, y int")
    got = sorted(df.select("k", F.array(*feature_columns(F.col("c"), F.col("b"), F.col("a"))).alias("x"), "y").collect())
    return grow_forest(np.array([r.x for r in got]), np.array([r.y for r in got], dtype=float))


def forest_of(spark: SparkSession) -> list:
    """Grown from FINDINGS labelled rows, once for an application."""
    key = spark.sparkContext.applicationId
    if key not in _forests:
        _forests.clear()
        _forests[key] = _grown(spark)
    return _forests[key]


def scan(docs: DataFrame, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_candidates, n_secrets, secrets (start and length in code points, score), clean_text.

    A candidate is a value of NAMED_LEAST characters or more after the name of a secret, or anywhere a run of
    LEAST characters or more of tokens and paths that has a digit or changes its case.  clean_text is
    the text with each secret replaced by a mark.  A null text has no candidates and stays null; ids may be
    null; repeated rows are scanned each; an empty table gives an empty result; further columns are
    not read, but for ``carry``, which keeps the row in a struct.
    """
    forest = forest_of(docs.sparkSession)
    row = [F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row")] if carry else []
    keep = ["row"] if carry else []
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row)
    none = F.array().cast("array<string>")
    has = F.coalesce(F.col("text").rlike(GATES[0]) | F.col("text").rlike(GATES[1]), F.lit(False))
    df = held(df, runs=F.when(has, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(none), gaps=F.when(has, F.split("text", CANDIDATE, -1)).otherwise(none))
    # runs that are no candidates are kept in their place and get a null
    before = lambda i: F.right(F.element_at("gaps", i + 1), F.lit(BEFORE))
    near = F.transform(
        "runs",
        lambda c, i: F.when(c.rlike(MIXED) | before(i).rlike(f"(?:{ASSIGNED}|(?i:bearer)\\s)$"), F.array(*feature_columns(c, before(i), F.left(F.element_at("gaps", i + 2), F.lit(AFTER))))),
    )
    df = held(df, features=near)
    df = held(df, scores=F.transform("features", lambda x: F.when(x.isNotNull(), F.round(forest_column(forest, x), 6))))
    is_secret = lambda i: F.coalesce(F.element_at("scores", i + 1) >= THRESHOLD, F.lit(False))
    begins = lambda i: F.aggregate(F.slice("gaps", F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("runs", F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g))
    places = F.transform("runs", lambda c, i: F.when(is_secret(i), F.struct(begins(i).alias("start"), F.length(c).alias("length"), F.element_at("scores", i + 1).alias("score"))))
    df = held(df, secrets=F.filter(places, lambda s: s.isNotNull()))
    parts = F.transform("gaps", lambda g, i: F.concat(g, F.when(i >= F.size("runs"), "").when(is_secret(i), REDACTED).otherwise(F.try_element_at("runs", i + 1))))
    clean = F.when(F.size("secrets") > 0, F.array_join(parts, "")).otherwise(F.col("text"))
    counted = F.size(F.filter("scores", lambda s: s.isNotNull())).cast("long")
    return df.select("doc_id", counted.alias("n_candidates"), F.size("secrets").cast("long").alias("n_secrets"), "secrets", clean.alias("clean_text"), *keep)


def redact(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with secrets in ``text`` replaced, and ``n_chars``, if there, set anew."""
    own = {"text": F.col("clean_text"), "n_chars": F.coalesce(F.length("clean_text"), F.lit(0)).cast("long")}
    return scan(docs, carry=True).select(*[own[c].alias(c) if c in own else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("clean_text")
