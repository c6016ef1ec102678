"""Secret scans: candidates judged by a random forest, DataFrame functions only.

A candidate is a run of at least 16 key-like characters with a digit, or a value
of at least 8 characters assigned to a secret's name or after Bearer. A name
that '=' joins to its value is not part of the candidate. Its
features: length, transitions between character classes, shares of classes,
distinct characters, dictionary coverage, hints in the path, and hints among the
words just before and after it. The dictionary is the words of a tokenizer's
vocabulary, given by its path, or a short list without one. Lengths are
parameters of :func:`candidates`; lower ones judge more and shorter runs. The forest is trained (in the JVM) from labelled findings
and drops false positives such as checksums, identifiers, card numbers,
addresses and placeholders.

Whole texts are scanned with one regular expression, without a shuffle.

Defined cases: null or empty text has no candidates; a null path has no hints;
repeated rows give their findings again; a null doc_id is kept; runs of letters
only are candidates after a secret's name alone; an unquoted value right after
'=' ends at '&'; an empty table gives no rows; other columns are
not read. Labelled findings with a null candidate or label are ignored; fewer
than two classes is an error.
"""

from __future__ import annotations

import itertools
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

LEAST, THRESHOLD = 16, 0.5
TREES, DEPTH, SEED = 24, 8, 7
#: Labelled findings that the built-in set holds.
FINDINGS = 6000
SHORTEST = 8
RUN = "A-Za-z0-9+/_.@~-"
#: Names whose values are candidates whatever their characters.
NAME = "(?:token|secret(?:[_-]?key)?|passw(?:or)?d|passwd|pwd|api.?key|access.?key|private.?key|authorization|credentials?|signature)"
_SPACED = rf"{NAME}[\"']?\s{{0,2}}[:=]\s{{1,2}}[\"']?|{NAME}[\"']?\s{{0,2}}[:=][\"']|bearer\s"
_JOINED = rf"{NAME}[\"']?\s{{0,2}}[:=]"


def candidate_pattern(least: int = LEAST, shortest: int = SHORTEST) -> str:
    """A name and its value of ``shortest`` characters, or runs of ``least`` that aren't a name before its value.

    Names are matched forward, not looked back for at every character.
    """
    value = rf"(?i:{_SPACED})(?!(?i:bearer)\s)[^\s\"'<>]{{{shortest - 1},}}[^\s\"'<>.,;:)\]}}]|(?i:{_JOINED})[^\s\"'<>&]{{{shortest - 1},}}[^\s\"'<>&.,;:)\]}}]"
    return rf"{value}|(?<![{RUN}])(?=[={RUN}]{{{least}}})(?![{RUN}]{{0,64}}?(?i:{NAME})[\"']?\s{{0,2}}[:=])[={RUN}]{{{least},}}+"


#: What a match begins with where it is a value: the name is no part of the candidate.
NAMED = rf"^((?i:{_SPACED})(?!(?i:bearer)\s)|(?i:{_JOINED}))"
ASSIGNED = f"({_SPACED}|{_JOINED})$"
#: Fixed word lists. Words that names and placeholders are made of:
DICTIONARY = (
    "about account address admin agent amount answer archive article author backup batch block board book branch build button cache campaign card "
    "category change chapter check city class client cloud code color column comment commit common company config contact content count country "
    "customer daily data date default demo design detail device digest document domain draft dummy edit email entry error event example export "
    "feature field file filter final first folder form format frame google group header height home host hour image import index info input inter "
    "item journal json label language last layer level library line link list local login mail main manager market master media member memory "
    "message meta method minute mobile model module month name network news night node note number object office option order package page "
    "panel parent part path people phone photo picture place player point post price print process product profile project public quality query "
    "question random rate record region release report request result review right root sample school score screen search second section "
    "select sequence server service session setting share shop simple site size small social source space sport staff stage start state static "
    "status storage store street string style subject summary support system table target team template test text theme thread time title "
    "topic total track travel type unit update user value version video view water week width window word world year"
).split()
#: Words before a secret, and before what only looks like one.
BEFORE_SECRET = "token|secret|passw|passwd|pwd|api.?key|apikey|access.?key|auth|bearer|credential|private|signature"
BEFORE_OTHER = "commit|sha1|sha256|md5|checksum|hash|digest|uuid|guid|version|revision|order|invoice|isbn|phone|card|mail|http|www|path|file|img|src|href"
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|your|xxxx|test|todo|redacted|0000|1234567"
PATH_OTHER = "test|example|sample|fixture|mock|doc|lock|vendor|dist"
#: Words right after what only looks like a secret.
AFTER_OTHER = "example|placeholder|dummy|changed|committed|modified|rows|bytes|isbn|order|page|chapter|downloads"
#: Words of the vocabulary that the dictionary takes, the most frequent first, and the characters of each.
DICTIONARY_WORDS, WORD_CHARS = 2000, (4, 14)
#: Characters before and after a candidate that its words are taken from.
NEAR_BEFORE, NEAR_AFTER = 48, 32
#: Prefixes that issuers give their keys.
PREFIX = "^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk_live_|sk-|rk_live_|AIza|ya29\\.|eyJ|glpat-|npm_|SG\\.)"
FEATURES = ["length", "transitions", "turn_rate", "digits", "capitals", "symbols", "distinct", "coverage", "vowels", "hex", "all_digits", "uuid", "address", "prefix", "placeholder", "path_other", "near_secret", "near_other", "assigned", "quoted", "after_other", "closed"]


def dictionary(path: str | None = None, words: int = DICTIONARY_WORDS) -> list[str]:
    """The first whole words of the vocabulary file at ``path``; the short list without one."""
    if path is None:
        return DICTIONARY
    with open(path, encoding="utf-8") as f:  # on the driver only
        vocab = json.load(f)["model"]["vocab"]
    ended = (t.removesuffix("</w>") for t in sorted(vocab, key=vocab.get) if t.endswith("</w>"))
    whole = (w for w in ended if re.fullmatch("[a-z]+", w) and WORD_CHARS[0] <= len(w) <= WORD_CHARS[1])
    return list(itertools.islice(whole, words))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, finding, candidate, before, after, path): ``before`` and ``after`` are what is next to it."""
    path = F.col(path_col).cast("string") if path_col and path_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), path.alias("path"))
    pattern = candidate_pattern(least, shortest)
    found = rows.select("doc_id", "path", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("own"), "text").where(F.size("own") > 0)
    near = lambda c, i, rest: F.struct(c.alias("match"), F.get(rest, i).alias("before"), F.get(rest, i + 1).alias("after"))
    # The texts between matches are bound once.
    zipped = F.transform(F.array(F.split("text", pattern, -1)), lambda rest: F.transform("own", lambda c, i: near(c, i, rest)))[0]
    each = found.select("doc_id", "path", F.posexplode(zipped).alias("finding", "f")).select("doc_id", "path", "finding", "f.*")
    name = F.regexp_extract("match", NAMED, 0)
    before = F.lower(F.right(F.concat("before", name), F.lit(NEAR_BEFORE)))
    return (
        each.select("doc_id", "finding", F.regexp_replace("match", NAMED, "").alias("candidate"), before.alias("before"), F.lower(F.left("after", F.lit(NEAR_AFTER))).alias("after"), "path")
        .where((F.col("candidate").rlike("[0-9]") & (F.char_length("candidate") >= least)) | F.col("before").rlike(ASSIGNED))
    )


def features(found: DataFrame, words: list[str] | None = None) -> DataFrame:
    """``found`` with the forest's features; ``words``: the dictionary."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.char_length(c).cast("double")
    share = lambda kept: F.char_length(F.regexp_replace(c, kept, "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0"), "[^aB0]+", "-")
    letters = F.regexp_replace(low, "[^a-z]", "")
    unknown = F.regexp_replace(letters, "|".join(sorted(words or DICTIONARY, key=lambda w: (-len(w), w))), "")
    flag = lambda col, pattern: F.coalesce(col.rlike(pattern), F.lit(False)).cast("double")
    made = {
        "length": F.least(n, F.lit(512.0)),
        "transitions": F.least(F.char_length(kinds).cast("double"), F.lit(256.0)),
        "turn_rate": F.char_length(kinds) / n,
        "digits": share("[^0-9]"),
        "capitals": share("[^A-Z]"),
        "symbols": share("[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(62.0)),
        "coverage": F.when(F.char_length(letters) == 0, 0.0).otherwise(1 - F.char_length(unknown) / F.char_length(letters)),
        "vowels": F.when(F.char_length(letters) == 0, 0.0).otherwise(F.char_length(F.regexp_replace(letters, "[^aeiou]", "")) / F.char_length(letters)),
        "hex": flag(low, "^[0-9a-f]+$"),
        "all_digits": flag(c, "^[0-9.-]+$"),
        "uuid": flag(low, "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
        "address": flag(low, "@|^www\\.|\\.(com|org|net|html|htm|png|jpg)\\b"),
        "prefix": flag(c, PREFIX),
        "placeholder": flag(low, PLACEHOLDER),
        "path_other": flag(F.lower("path"), PATH_OTHER),
        "near_secret": flag(F.col("before"), BEFORE_SECRET),
        "near_other": flag(F.col("before"), BEFORE_OTHER),
        "assigned": flag(F.col("before"), "[:=] *[\"']?$"),
        "quoted": flag(F.col("before"), "[\"']$"),
        "after_other": flag(F.col("after"), AFTER_OTHER),
        "closed": flag(F.col("after"), "^[\"']"),
    }
    return found.withColumns({k: v.cast("double") for k, v in made.items()})


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """(candidate, before, after, path, label): the built-in findings, made from hashes of 0 .. n-1."""

    def pick(salt: int, options: list):
        own = F.split(F.lit("\n".join(map(str, options))), "\n")  # folded into one literal
        one = F.element_at(own, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(options))) + 1).cast("int"))
        return one.cast("int") if isinstance(options[0], int) else one

    number = lambda salt, least, most: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(most - least + 1)) + least).cast("int")
    raw = F.concat(*[F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(i))), 256) for i in range(3)])
    hexed = F.substring(raw, F.lit(1), pick(1, [32, 32, 48, 56, 64]))
    mixed = F.substring(F.regexp_replace(F.base64(F.unhex(raw)), "[\\r\\n]", ""), F.lit(1), number(2, 20, 64))
    plain = F.regexp_replace(mixed, "[+/=]", "7")
    digits = F.regexp_replace(raw, "[a-f]", "")
    word = lambda salt: pick(salt, DICTIONARY[:200])
    sep = pick(3, ["_", "-", ".", ""])
    named = F.concat(word(4), sep, word(5), sep, word(6), sep, number(7, 1, 2030).cast("string"))
    uuid = F.regexp_replace(F.substring(raw, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    case = pick(8, [0, 0, 0, 1])
    upper = lambda col: F.when(case == 1, F.upper(col)).otherwise(col)
    asks = pick(9, ['auth_key: "', "session_token: ", "api_key = '", "apikey=", "secret = ", "password: ", "authorization: bearer ", "access_key=", "client_secret: ", 'auth_token="'])
    tells = pick(10, ["commit ", "sha256:", "checksum = ", "md5 ", "etag ", "revision: ", "uuid=", "digest: ", "build ", "file "])
    idle = F.concat(word(11), F.lit(" "), word(12), pick(13, [" ", " ", ": ", " = ", ' "']))
    number_before = pick(14, ["order ", "phone ", "card ", "", "invoice: ", "call ", "token "])
    letters = F.regexp_replace(plain, "[0-9]", "k")
    short = F.substring(plain, F.lit(1), number(30, 8, 15))
    marked = F.concat(F.substring(plain, 1, 5), pick(31, ["!", "#", "$", "&", "%"]), F.substring(plain, F.lit(6), number(32, 3, 9)), pick(33, ["!", "#", "", "*", "?"]))
    options = [  # candidate, before, label; each makes an equal share
        (upper(hexed), asks, 1), (upper(hexed), asks, 1), (plain, asks, 1), (mixed, asks, 1),
        (F.concat(pick(15, ["AKIA", "ASIA"]), F.substring(F.upper(plain), 1, 16)), idle, 1),
        (F.concat(pick(16, ["ghp_", "sk_live_", "glpat-", "npm_"]), F.substring(F.concat(plain, plain), 1, 36)), idle, 1),
        (short, asks, 1), (marked, asks, 1), (letters, asks, 1), (F.substring(letters, F.lit(1), number(34, 10, 24)), asks, 1),
        (F.concat(word(35), sep, word(36)), asks, 0), (F.concat(word(37), sep, word(38), sep, word(39)), asks, 0),
        (upper(hexed), tells, 0), (upper(hexed), F.concat(idle, tells), 0), (uuid, F.concat(idle, pick(17, ["id=", "uuid: ", "session "])), 0),
        (F.substring(digits, F.lit(1), number(18, 17, 24)), F.concat(idle, number_before), 0),
        (named, idle, 0), (named, asks, 0),
        (F.concat(word(19), pick(40, ["_", "-", ""]), number(20, 1, 99).cast("string"), F.lit("@"), word(41), F.lit("."), word(21), pick(42, [".org", ".net", ".io", ".co.uk"])), idle, 0),
        (F.concat(pick(22, ["your-", "example_", "xxxxxxxx", "changeme-"]), word(23), F.lit("-1234567890")), asks, 0),
        (F.concat(F.lit("/"), word(24), F.lit("/"), word(25), F.lit("/"), number(26, 1, 99999).cast("string"), F.lit(".html")), idle, 0),
        (F.concat(F.lit("2024-0"), number(27, 1, 9).cast("string"), F.lit("-1"), number(28, 0, 9).cast("string"), F.lit("-10.30.22.123")), idle, 0),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(options)))
    made = F.element_at(F.array(*[F.struct(F.rpad(c, 16, "0").alias("short"), c.alias("candidate"), F.lower(b).alias("before"), F.lit(y).alias("label")) for c, b, y in options]), (kind + 1).cast("int"))
    rows = spark.range(0, n, 1, 1).select(made.alias("m"), pick(29, ["src0", "src1", "docs", "config", "tests/data", "web"]).alias("path"), F.concat(pick(43, [" ", "\n", ", ", "; "]), word(44), F.lit(" "), word(45)).alias("after"))
    after = F.concat(F.when(F.col("m.before").rlike("[\"']$"), F.right("m.before", F.lit(1))).otherwise(""), F.col("after"))
    made = rows.select(F.when(F.char_length("m.candidate") < SHORTEST, F.col("m.short")).otherwise(F.col("m.candidate")).alias("candidate"), "m.before", after.alias("after"), "path", "m.label")
    return settle(made, "labelled-findings")


def train(findings: DataFrame, words: list[str] | None = None):
    """The fitted pipeline (assembler and forest) from labelled findings."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = features(findings.where("candidate is not null and label in (0, 1)"), words).coalesce(1)
    if rows.select("label").distinct().count() < 2:
        raise ValueError("labelled findings must hold both classes")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows.withColumn("label", F.col("label").cast("double")))


def scan(docs: DataFrame, model=None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", words: list[str] | None = None, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, finding, candidate, before, after, path, score, secret) of every candidate.

    A given model must have been trained with the same ``words``.
    """
    from pyspark.ml.functions import vector_to_array

    model = model or train(labelled_findings(docs.sparkSession), words)
    judged = model.transform(features(candidates(docs, id_col, text_col, path_col, least, shortest), words))
    score = F.round(vector_to_array("probability")[1], 6)
    return judged.select("doc_id", "finding", "candidate", "before", "after", "path", score.alias("score"), (score >= threshold).alias("secret"))
