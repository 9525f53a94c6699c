"""Personal identifiers by bootstrapped contextual extraction.

Every string between white space, delimiters such as commas, quotes and brackets, and changes to or from a script without
spaces that holds a digit or an at sign is an instance (a telephone number's parts are joined), and so is what
follows a label with a colon or equals sign, whatever it holds. In a string of more than LONG characters, whose parts
nothing separates, every checked form that stands in it is an instance.
Checked forms - addresses, card numbers with a right check digit, and so on - are the seeds of their types. Instances have
lexical patterns: their own shape, the words on either side, the word before a colon or equals sign. Spark scores the graph
of patterns and instance values in rounds: a pattern's confidence in a type is the scores of its values over their number
plus CAUTION; a value's score is the chance that any of its patterns of confidence TRUSTED or more is right. So patterns
that the seeds suggest find identifiers that no check knows, and the forms of version or list numbers never gain trust.

The graph holds instances only, a small part of the corpus; each round is two joins and two aggregations with map-side
sums, so a shape that millions of values share is no bottleneck, and every round's scores are written. The patterns trusted
in a round are broadcast if they are FEW at most, and joined by a shuffle otherwise. Of all that is written, only the
result is left in the end.

Defined results: null and empty texts, and rows with a null doc_id, give nothing. Texts and strings of any length are
searched to their end. Repeated documents give a row each.
A value of several types gets the one of best score, of equals the first by name. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, in_arrow, spread, table

ROUNDS = 3
CAUTION = 2.0
TRUSTED = 0.5
ACCEPTED = 0.6
LONG = 200
FEW = 100_000

_TELLING = re.compile(r"[@0-9]")
_SLOT = re.compile(r"[:=] ?[A-Za-z]")
_SPACE = re.compile(r"\s")
_SOLID = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"  # scripts without spaces
_CUT = re.compile(rf"""(?<=[{_SOLID}])(?=[!-~])|(?<=[!-~])(?=[{_SOLID}])|[,;|"<>&{{}}\[\]?]|=(?=[^\s=])|\((?!\d{{2,4}}\))|(?<!\(\d{{2}})(?<!\(\d{{3}})(?<!\(\d{{4}})\)""")  # not around an area code
_NUMERIC = re.compile(r"[0-9()+./\-]+")
_RUN = re.compile(r"[0-9]+|[a-zà-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+|[^\W\d_]+|.", re.S)
_WORD = re.compile(r"[\w@=:+#]+")

_SEEDS = {
    "email": re.compile(r"[\w.+\-]+@(?:[\w\-]+\.)+[A-Za-z]{2,}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    "phone": re.compile(r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}"),
    "national_id": re.compile(r"\d{3}-\d{2}-\d{4}"),
    "key": re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}"),
}
_CARD = re.compile(r"\d{13,19}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")
_SECRET = re.compile(r"(?=.*\d)[0-9A-Za-z_\-+/]{12,}")
# checked forms inside longer strings
_LOCAL = re.compile(r"[\w.+\-]{1,64}$")
_HOST = re.compile(r"(?:[\w\-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z])")
_WITHIN = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])|(?<!\d)\d{13,19}(?!\d)|(?<![0-9A-Za-z])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])"
    r"|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])|(?<![\d\-])\d{3}-\d{3}-\d{4}(?![\d\-])"
)
_LABELS = {"password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "access_token"}


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def seed_type(value: str, label: str) -> str | None:
    """The type of a value that passes a check."""
    for name, form in _SEEDS.items():
        if form.fullmatch(value):
            return name
    if _CARD.fullmatch(value) and luhn(value):
        return "card"
    if _IBAN.fullmatch(value) and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
        return "iban"
    if label in _LABELS and _SECRET.fullmatch(value):
        return "secret"
    return None


def shape(value: str) -> str:
    """The form of a value: kinds of characters in turn; strings that mix letters and digits by kind and length."""
    out = []
    for part in re.findall(r"[^\W_]+|[\W_]", value):
        if not part[0].isalnum():
            out.append(part)
        elif part.isdigit():
            out.append("9" if len(part) < 4 else f"9{{{len(part)}}}")
        elif any(c.isdigit() for c in part) and len(part) > 8:
            kind = "h" if re.fullmatch(r"[0-9a-f]+", part) else "A" if part.upper() == part else "a" if part.lower() == part else "m"
            out.append(f"{kind}{{{len(part)}}}")
        else:
            out += ["9" if x[0].isdigit() else "A" if x.isupper() else "a" for x in _RUN.findall(part)]
    return "".join(out)


def coarse(value: str) -> str:
    """A rough form, so that a context says something about values of one sort only."""
    if "@" in value:
        return "at"
    if any(c.isalpha() for c in value):
        return "mixed"
    return "digits" if len(re.sub(r"\D", "", value)) >= 7 else "few"


def slot(text: str, low: int, high: int) -> bool:
    """Whether a letter after a label's colon or equals sign stands between low and high."""
    return any(m.start() and (text[m.start() - 1].isalpha() or text[m.start() - 1] == "_") and m.end() > low for m in _SLOT.finditer(text, max(0, low - 2), high))


def within(text: str, low: int, high: int, mails_only: bool) -> list[tuple[int, int]]:
    """Checked forms inside a longer string."""
    out = []
    at = low
    while (p := text.find("@", at, high)) >= 0:
        local, host = _LOCAL.search(text[max(low, at, p - 64) : p]), _HOST.match(text, p + 1, high)
        at = p + 1
        if local and host:
            out.append((p - len(local.group()), host.end()))
            at = host.end()
    if not mails_only:
        out = sorted(out + [m.span() for m in _WITHIN.finditer(text, low, high)])
    return out


def instances(text: str) -> Iterator[tuple[int, int, str, str, list[str]]]:
    """Start, end, value, label and the words around of each instance of a text."""
    spans: list[tuple[int, int]] = []

    def put(low: int, high: int) -> None:
        if not _TELLING.search(text, low, high):
            if high > low and high - low <= LONG and slot(text, low, high):
                spans.append((low, high))
        elif high - low > LONG:
            spans.extend(within(text, low, high, False))
        elif text.find("@", low, high) >= 0 and (inner := within(text, low, high, True)):
            spans.extend(inner)
        else:
            spans.append((low, high))

    at, told, named = 0, _TELLING.search(text), _SLOT.search(text)
    while told or named:
        p = min(told.start() if told else len(text), named.end() - 1 if named else len(text))
        low = p
        while low > at and not text[low - 1].isspace():
            low -= 1
        end = _SPACE.search(text, p)
        high = end.start() if end else len(text)
        at = high
        for cut in _CUT.finditer(text, low, high):
            put(low, cut.start())
            low = cut.end()
        put(low, high)
        if told and told.start() < at:
            told = _TELLING.search(text, at)
        if named and named.end() <= at:
            named = _SLOT.search(text, max(0, at - 1))
            while named and named.end() <= at:
                named = _SLOT.search(text, named.end())
    k = 0
    while k < len(spans):
        low, high = spans[k]
        k += 1
        part = text[low:high]

        def joins(x: str) -> bool:
            return bool(_NUMERIC.fullmatch(x.rstrip(".,;"))) and x.count(".") < 3 and sum(map(str.isdigit, x)) <= 8

        if joins(part) and part[-1] not in ".,;":
            while k < len(spans) and spans[k][0] == high + 1 and text[high].isspace() and joins(text[spans[k][0] : spans[k][1]]) and spans[k][1] - low <= 30:
                high = spans[k][1]
                k += 1
                if text[high - 1] in ".,;":
                    break
        value, label = text[low:high], ""
        cut = re.match(r"([A-Za-z_]{2,30})[=:](?=.)", value)
        if cut and "@" not in cut.group():
            label, low = cut.group(1).lower(), low + cut.end()
            value = text[low:high]
        while value and (value[0] in "\"'<[{,;:*&$%#|" or value[0] == "(" and ")" not in value):
            low, value = low + 1, value[1:]
        while value and (value[-1] in "\"'>]},;:.!?*&$%#|" or value[-1] == ")" and "(" not in value):
            high, value = high - 1, value[:-1]
        left = _WORD.findall(text[max(0, low - 60) : low].lower())[-3:]
        right = _WORD.findall(text[high : high + 60].lower())[:2]
        if not label:
            words = [x for x in left if x.strip("=:")]
            if left and left[-1][-1:] in "=:" and words:
                label = words[-1].rstrip("=:")
        if not value or not label and not _TELLING.search(value):
            continue
        yield low, high, value, label, ["", "", *left][-2:] + [*right, "", ""][:2]


def patterns(value: str, label: str, around: list[str]) -> list[str]:
    """The lexical patterns of an instance."""
    c = coarse(value)
    l2, l1, r1, r2 = around
    if not _TELLING.search(value):
        return [f"slot {label}"]
    out = [f"form {shape(value)}"]
    if label:
        out += [f"label {label} {c}", f"slot {label}"]
    if l1 and r1:
        out.append(f"between {l1} {c} {r1}")
    if l1 and l2:
        out.append(f"after {l2} {l1} {c}")
    if r1 and r2:
        out.append(f"before {c} {r1} {r2}")
    return out


def instance_table(documents: DataFrame) -> DataFrame:
    """doc_id, start, end, value, seed, patterns of every instance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i.as_py(), low, high, value, seed_type(value, label), patterns(value, label, around)) for i, t in zip(b.column(0), b.column(1)) for low, high, value, label, around in instances(t.as_py())]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "end", "value", "seed", "patterns"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return in_arrow(spread(rows), run, "doc_id long, start long, end long, value string, seed string, patterns array<string>")


def scores(found: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """value, type, score after the rounds."""
    edges = scratch.save(found.select("value", F.explode("patterns").alias("pattern")).distinct(), "edges")
    seeds = scratch.save(found.filter("seed is not null").select("value", F.col("seed").alias("type")).distinct().withColumn("score", F.lit(1.0)), "seeds")
    degree = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    current = seeds
    for _ in range(rounds):
        support = edges.join(current, "value").groupBy("pattern", "type").agg(F.sum("score").alias("s"))
        confident = support.join(degree, "pattern").withColumn("confidence", F.col("s") / (F.col("n") + CAUTION)).filter(F.col("confidence") >= TRUSTED)
        trusted = scratch.save(confident.select("pattern", "type", "confidence"), "trusted")
        told = F.broadcast(trusted) if trusted.count() <= FEW else trusted  # patterns are of a few hundred bytes at most
        miss = F.sum(F.log1p(-F.least("confidence", F.lit(0.999))))
        learnt = edges.join(told, "pattern").groupBy("value", "type").agg((1 - F.exp(miss)).alias("score"))
        before, current = current, scratch.save(learnt.union(seeds).groupBy("value", "type").agg(F.max("score").alias("score")), "scores")
        scratch.remove(trusted, *([] if before is seeds else [before]))
    scratch.remove(edges, seeds)
    return current


def identifiers(documents: DataFrame) -> DataFrame:
    """doc_id, start, end, value, type, score, seed (whether a check knew it) of every identifier found."""
    scratch = Scratch(documents.sparkSession)
    found = scratch.save(instance_table(documents), "instances")
    best = Window.partitionBy("value").orderBy(F.desc("score"), "type")
    scored = scores(found, scratch)
    typed = scored.filter(F.col("score") >= ACCEPTED).withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(F.col("value").alias("v"), "type", "score")
    out = scratch.save(found.join(typed, F.col("value") == F.col("v")).select("doc_id", "start", "end", "value", "type", "score", F.col("seed").isNotNull().alias("seed")), "identifiers")
    scratch.remove(found, scored)
    return out


def private_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers(table(spark, sf_dir, "documents"))
