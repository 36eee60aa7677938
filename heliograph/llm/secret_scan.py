"""Secret scans with a random forest that removes false positives, in DataFrame and SQL functions only.

A text is split at candidates, of these kinds:

* what is assigned (``=`` or ``:``) to a word for secrets, such as password or api_key: the quoted value, or else the
  next 6 characters or more without a blank, in any alphabet;
* private key blocks; credentials in addresses (``://user:secret@``); words with a prefix that services give their keys;
* runs of 16 or more key-like characters with a digit.

A candidate is the whole value, however long. Nothing else is looked at: a secret of words, or of fewer than 16 characters, that nothing announces is missed.

Each candidate keeps the text before and after it. Features are its length, character transitions, the share of its
letters that dictionary words cover, its path (the row's source and any path it stands in) and the neighbouring words.
The forest is fitted on labelled findings and then written out as one SQL expression over a row's candidates, so that
scoring needs no shuffle and keeps every row. Dictionary words are the commonest words of all texts.

Labelled findings are rows (before, candidate, after, path, is_secret). :func:`findings_from_texts` builds some from a
bounded sample of texts where there are no others: keys and passwords of many shapes, with and without a word that
announces them, and placeholders, digests, dates, names and plain words in the places where secrets stand, with the label
known from how they were made.

Defined cases: a null text has no candidates; a null path is empty; the character U+FDD0 counts as a blank; a table
without labelled findings of both kinds calls every candidate a secret. Rows, repeated ones too, and extra columns stay.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import discard, hashed_share, materialise

#: Rows drawn for labelled findings, words of the dictionary, and the forest's size: the bounds of the fit.
SAMPLE_ROWS, DICTIONARY_WORDS, TREES, DEPTH = 4000, 400, 25, 8
CONTEXT = 48
LEAST_SCORE = 0.5
PLACEHOLDER = "[SECRET]"
_MARK = "﷐"
# Words beside a value that tell its kind, places in which values are harmless, prefixes of services' keys,
# and what stands where a secret is left out.
SECRET_WORDS = "token secret password passwd passphrase pwd api_key apikey api-key access_key private_key credential credentials auth bearer client_secret".split()
HARMLESS_WORDS = "commit sha sha1 sha256 md5 checksum digest hash etag uuid guid revision id isbn card phone order invoice serial".split()
HARMLESS_PATHS = "test tests example examples fixture fixtures vendor lock docs objects blob".split()
KEY_PREFIXES = [
    "AKIA[0-9A-Z]{16}", r"AIza[0-9A-Za-z_\-]{35}", "gh[pousr]_[0-9A-Za-z]{36}", r"xox[abprs]-[0-9A-Za-z\-]{10,}", "[sr]k_live_[0-9A-Za-z]{16,}", r"glpat-[0-9A-Za-z_\-]{20}",
    r"eyJ[0-9A-Za-z_\-]+\.[0-9A-Za-z_\-]+\.[0-9A-Za-z_\-]+",
]
PLACEHOLDERS = r"(?i)^(<.*|\$.*|%.*|\{.*|\[.*|(.)\2{3,}|.*(changeme|change_me|example|placeholder|redacted|dummy|sample|insert|your).*|(none|null|true|false|todo|test|nothing|undefined).*)$"
_ANNOUNCED = r"(?<![A-Za-z0-9])(?i:(?:[a-z0-9]{1,20}[_\-])?(?:" + "|".join(re.escape(w) for w in sorted(SECRET_WORDS, key=len, reverse=True)) + r")(?:[_\-][a-z0-9]{1,20})?[\"']?\s{0,3}[=:]\s{0,3})"
_BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}-----END [A-Z ]{0,20}PRIVATE KEY-----"
_RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}={0,2}"
#: Odd groups hold what stays before a value, even ones and the last the value.
CANDIDATE = (
    f"({_ANNOUNCED}[\"'])" + r"([^\"'\n]{4,})(?=[\"'])|" + f"({_ANNOUNCED})" + r"([^\s\"'<>,;]{6,})|(://[^\s/:@]+:)([^\s/@]{3,})(?=@)|"
    + f"({_BLOCK}|(?<![A-Za-z0-9])(?:{'|'.join(KEY_PREFIXES)})(?![A-Za-z0-9])|{_RUN})"
)
FEATURES = [
    "length", "transitions", "digit_share", "upper_share", "different", "hex", "digits_only", "covered", "longest_letters", "in_path", "harmless_path", "secret_word", "harmless_word", "assigned", "quoted", "other_share", "blanks", "known_form",
    "in_address", "placeholder",
]


def _any(words: list[str]) -> str:
    return "(?i)(?<![a-z0-9])(" + "|".join(re.escape(w).replace("\\-", "-") for w in words) + ")(?![a-z0-9])"


def features(candidate: Column, before: Column, after: Column, path: Column, dictionary: list[str]) -> dict[str, Column]:
    """Feature columns of one candidate and its surroundings; all are double and none is null."""
    n = F.char_length(candidate)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[0-9]", "\u0001"), "[a-z]", "\u0002"), "[A-Z]", "\u0003"), "[^\u0001-\u0003]", "\u0004")
    runs = F.filter(F.split(F.lower(candidate), "[^a-z]+"), lambda w: F.char_length(w) >= 3)
    known = F.array(*[F.lit(w) for w in dictionary]) if dictionary else F.array().cast("array<string>")
    letters = F.char_length(F.regexp_replace(candidate, "[^A-Za-z]", ""))
    covered = F.aggregate(F.filter(runs, lambda w: F.array_contains(known, w)), F.lit(0), lambda s, w: s + F.char_length(w))
    tail = F.substring(before, -CONTEXT, CONTEXT)
    where = F.concat_ws("/", F.coalesce(path, F.lit("")), F.regexp_extract(tail, r"(\S*/)$", 1))
    share = lambda kept: F.char_length(F.regexp_replace(candidate, kept, "")) / n
    out = {
        "length": n,
        "transitions": (F.char_length(F.regexp_replace(kinds, "(.)\\1+", "$1")) - 1) / n,
        "digit_share": share("[^0-9]"),
        "upper_share": share("[^A-Z]"),
        "different": F.size(F.array_distinct(F.split(candidate, ""))) / n,
        "hex": candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "digits_only": candidate.rlike("^[0-9]+$"),
        "covered": F.when(letters > 0, covered / letters).otherwise(0),
        "longest_letters": F.coalesce(F.array_max(F.transform(runs, F.char_length)), F.lit(0)),
        "in_path": tail.rlike(r"/\S*$") | candidate.rlike("/.*/"),
        "harmless_path": where.rlike(_any(HARMLESS_PATHS)),
        "secret_word": F.regexp_extract(tail, r"(\S+\s*[=:]?\s*[\"']?)$", 1).rlike(_any(SECRET_WORDS)) | F.regexp_extract(tail, r"(\S+\s+\S+\s*)$", 1).rlike(_any(SECRET_WORDS)),
        "harmless_word": tail.rlike(_any(HARMLESS_WORDS)),
        "assigned": tail.rlike(r"[=:]\s*[\"']?$"),
        "quoted": tail.rlike("[\"']$") & after.rlike("^[\"']"),
        "other_share": share("[A-Za-z0-9]"),
        "blanks": F.char_length(F.regexp_replace(candidate, "\\S", "")),
        "known_form": candidate.rlike(f"^({'|'.join(KEY_PREFIXES)})$") | candidate.startswith("-----BEGIN "),
        "in_address": tail.rlike(r"://[^\s/:@]+:$"),
        "placeholder": candidate.rlike(PLACEHOLDERS),
    }
    return {name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in out.items()}


def common_words(docs: DataFrame, most: int = DICTIONARY_WORDS) -> list[str]:
    """The commonest words of three letters or more over all texts; ``most`` of them at most reach the driver."""
    words = docs.select(F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("w")).where(F.char_length("w").between(3, 30))
    return [r["w"] for r in words.groupBy("w").count().where("count > 1").orderBy(F.desc("count"), "w").limit(most).collect()]


def findings_from_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled findings made from a share of the texts by hash that makes about ``rows``, one of each.

    They are written to the shared folder, since fitting reads them again and again. Digests of a text stand for random
    keys. Equal strings come with both labels, told apart by their surroundings. ``shape`` numbers how one was made.
    """
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    total = docs.count()
    base = base.where(hashed_share(min(1.0, rows / max(total, 1)), "doc_id", "text")).withColumn("h", F.xxhash64("doc_id", "text", F.lit(1)))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    base = base.withColumn("words", words).where(F.size("words") > 0).withColumn("at", F.pmod(F.shiftright("h", 8), F.size("words")).cast("int"))
    near = lambda start, count: F.array_join(F.slice("words", start, count), " ")
    left = F.concat(near(F.greatest(F.col("at") - 3, F.lit(1)), F.lit(4)), F.lit(" "))
    right = F.concat(F.lit(" "), near(F.col("at") + 1, F.lit(3)))
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.shiftright("h", k), F.lit(len(values))) + 1).cast("int"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    key, mark = pick(SECRET_WORDS, 20), pick(HARMLESS_WORDS, 20)
    name = F.when(F.pmod(F.shiftright("h", 30), F.lit(3)) == 0, F.upper(key)).otherwise(key)
    sign = pick(["=", ": ", " = ", " := "], 34)
    size = lambda low, high: (F.pmod(F.shiftright("h", 40), F.lit(high - low + 1)) + low).cast("int")
    sha, md5, sha2 = F.sha1("text"), F.md5("text"), F.sha2("text", 512)
    b64 = F.regexp_replace(F.base64(F.unhex(sha2)), "\\s", "")
    mixed = F.regexp_replace(b64, "[+/=]", "")
    digits = F.translate(sha2, "abcdef", "012345")
    word = lambda k: F.regexp_replace(F.lower(F.get("words", F.pmod(F.shiftright("h", k), F.size("words")).cast("int"))), "[^a-z]", "")
    long_word = F.rpad(word(12), 7, "ing")
    uuid = F.concat_ws("-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.substring(md5, 17, 12))
    cut = lambda text, n: F.substring(text, F.lit(1), n if not isinstance(n, int) else F.lit(n))
    nothing = F.lit("")
    shapes = [
        (say(left, name, "="), cut(b64, size(24, 60)), nothing, 1),
        (say(left, name, ": "), say("k9_", cut(mixed, size(20, 40))), nothing, 1),
        (say(left, name, " "), md5, nothing, 1),
        (say(left, name, sign, '"'), cut(mixed, size(16, 48)), F.lit('"'), 1),
        (say(left, "db_", name, sign), F.translate(cut(mixed, size(9, 16)), "aeiouKM", "@!#$%&*"), nothing, 1),
        (say(left, name, sign, "'"), say(word(12), "-", word(16), "-", word(24), cut(digits, 2)), F.lit("'"), 1),
        (left, say("AKIA", F.upper(cut(mixed, 16))), nothing, 1),
        (left, say("ghp_", cut(mixed, 36)), nothing, 1),
        (left, say("-----BEGIN PRIVATE KEY-----\n", b64, "\n-----END PRIVATE KEY-----"), nothing, 1),
        (say(left, "https://", word(12), ":"), cut(mixed, size(8, 24)), say("@host.", word(16)), 1),
        (say(left, name, " "), say("eyJ", cut(mixed, 20), ".", cut(b64, 0), cut(F.reverse(mixed), 30), ".", cut(mixed, size(20, 40))), nothing, 1),
        (say(left, "export ", F.upper(key), "="), cut(sha2, size(44, 70)), nothing, 1),
        (say(left, name, ': "'), md5, F.lit('"'), 1),
        (say(left, name, sign, '"'), say(word(12), " ", word(16), " ", word(24), cut(digits, 3), "!"), F.lit('"'), 1),
        (say(left, mark, " "), sha, nothing, 0),
        (say(left, mark, ": "), cut(sha2, 64), nothing, 0),
        (say(left, "files/objects/"), md5, nothing, 0),
        (left, cut(digits, 16), nothing, 0),
        (say(left, mark, " = "), cut(digits, size(16, 24)), nothing, 0),
        (left, say(cut(F.rpad(F.regexp_replace(F.lower(F.array_join(F.slice("words", 1, 5), "")), "[^a-z]", "x"), 20, "x"), 20), "2024"), nothing, 0),
        (left, uuid, nothing, 0),
        (say(left, name, ": "), long_word, nothing, 0),
        (say(left, name, sign, '"'), say(long_word, " ", word(16), " ", word(24)), F.lit('"'), 0),
        (say(left, name, sign), say("${", F.upper(long_word), "}"), nothing, 0),
        (say(left, name, sign, '"'), say("your-", word(12), "-here"), F.lit('"'), 0),
        (say(left, name, sign), pick(["changeme", "example", "redacted", "None,none", "placeholder", "undefined"], 44), nothing, 0),
        (say(left, name, sign, '"'), F.repeat(pick(["x", "*", "0", "."], 44), size(6, 24)), F.lit('"'), 0),
        (say(left, name, ": "), say("2024-0", cut(digits, 1), "-1", F.substring(digits, 2, 1)), nothing, 0),
        (say(left, name, sign), say(long_word, ".", word(16), "_", word(24)), nothing, 0),
        (say(left, mark, sign, '"'), sha, F.lit('"'), 0),
        (say(left, mark, sign, '"'), md5, F.lit('"'), 0),
        (say(left, "https://www."), say(long_word, "/", word(16), "-", word(24), "/", cut(digits, 8)), nothing, 0),
        (left, say(long_word, "_", word(16), "_", word(24), "_v", cut(digits, 1)), nothing, 0),
        (say(left, name, "_", mark, ": "), uuid, nothing, 0),
    ]
    kind = F.pmod(F.shiftright("h", 3), F.lit(len(shapes))).cast("int")
    of = lambda k: reduce(lambda rest, i: F.when(kind == i, shapes[i][k] if isinstance(shapes[i][k], Column) else F.lit(shapes[i][k])).otherwise(rest), range(len(shapes)), F.lit(None))
    made = base.select(of(0).alias("before"), of(1).alias("candidate"), F.concat(of(2), right).alias("after"), pick(["src", "web", "config/env", "notes", ""], 50).alias("path"), of(3).alias("is_secret"), kind.alias("shape"))
    return materialise(made, "findings")


def _expression(tree: str) -> str:
    """A tree's printed form as a SQL expression with {name} for each feature."""
    lines = [line.strip() for line in tree.splitlines()[1:]]

    def read() -> str:
        line = lines.pop(0)
        if m := re.match(r"Predict: (\S+)", line):
            return m[1]
        name, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = read()
        lines.pop(0)  # Else
        return f"CASE WHEN {{{FEATURES[int(name)]}}} <= {bound}D THEN {low} ELSE {read()} END"

    return read()


class Forest:
    """A fitted forest: SQL expressions of its trees, and the dictionary that its features use; kept as JSON, it scans other tables as it is."""

    def __init__(self, trees: list[str], dictionary: list[str]):
        self.trees, self.dictionary = trees, dictionary

    def score(self, values: str) -> str:
        """SQL for the share of trees that vote for a secret, over a struct of features named ``values``."""
        if not self.trees:
            return "1.0D"
        votes = [t.format(**{f: f"{values}.{f}" for f in FEATURES}) for t in self.trees]
        return "(" + " + ".join(votes) + f") / {len(votes)}D"


    def to_json(self) -> str:
        return json.dumps({"trees": self.trees, "dictionary": self.dictionary})

    @classmethod
    def from_json(cls, text: str) -> Forest:
        kept = json.loads(text)
        return cls(kept["trees"], kept["dictionary"])


def _featured(findings: DataFrame, dictionary: list[str]) -> DataFrame:
    known = findings.where(F.col("candidate").isNotNull() & F.col("is_secret").isNotNull()).select(F.coalesce("before", F.lit("")).alias("before"), "candidate", F.coalesce("after", F.lit("")).alias("after"), "path", F.col("is_secret").cast("double").alias("label"))
    return known.select("label", *[c.alias(n) for n, c in features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), dictionary).items()])


def fit_forest(findings: DataFrame, dictionary: Sequence[str] = (), trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Fit on labelled findings. They are few, and put in one order, so that the forest doesn't depend on their partitions."""
    dictionary = list(dictionary)
    rows = _featured(findings, dictionary).repartition(1).sortWithinPartitions("label", *FEATURES)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("label", "features")
    if {r["label"] for r in rows.select("label").distinct().limit(3).collect()} != {0.0, 1.0}:
        return Forest([], dictionary)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, maxBins=64).fit(rows)
    return Forest([_expression(t.toDebugString) for t in model.trees], dictionary)


def fit_on_texts(docs: DataFrame) -> Forest:
    """A forest for a corpus without labelled findings: some made from its texts, and its commonest words."""
    findings = findings_from_texts(docs)
    forest = fit_forest(findings, common_words(docs))
    discard(findings)
    return forest


def scan(docs: DataFrame, forest: Forest, path: str | None = "source") -> DataFrame:
    """``docs`` with ``pieces`` (text between candidates) and ``findings``, an array of (candidate, score, is_secret)."""
    blank = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _MARK, " ")
    split = F.split(F.regexp_replace(blank, CANDIDATE, f"$1$3$5{_MARK}$2$4$6$7{_MARK}"), _MARK)
    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    rows = docs.withColumn("pieces", split)

    def described(i: Column) -> Column:
        at = F.col("pieces")
        own = features(F.get(at, i), F.get(at, i - 1), F.get(at, i + 1), where, forest.dictionary)
        return F.struct(F.get(at, i).alias("candidate"), *[c.alias(n) for n, c in own.items()])

    places = F.when(F.size("pieces") > 2, F.sequence(F.lit(1), F.size("pieces") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_described", F.transform(places, described))
    found = F.expr(f"transform(_described, x -> named_struct('candidate', x.candidate, 'score', {forest.score('x')}))")
    found = F.transform(found, lambda x: F.struct(x["candidate"].alias("candidate"), x["score"].alias("score"), (x["score"] >= LEAST_SCORE).alias("is_secret")))
    return rows.withColumn("findings", found).drop("_described")


def redact(docs: DataFrame, forest: Forest, path: str | None = "source") -> DataFrame:
    """``docs`` with secrets replaced by a placeholder; n_chars, where there is one, follows the text."""
    columns = [F.col("text").cast("string").alias("text"), *([F.col(path).alias("_path")] if path in docs.columns else [])]
    found = scan(docs.select(F.struct("*").alias("_row"), *columns), forest, "_path")
    kept = F.transform("pieces", lambda piece, i: F.when((i % 2 == 1) & F.get(F.col("findings"), F.floor(i / 2).cast("int"))["is_secret"], F.lit(PLACEHOLDER)).otherwise(piece))
    touched = F.exists("findings", lambda x: x["is_secret"])
    changed = {"text": F.when(touched, F.array_join(kept, "")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.char_length(changed["text"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
