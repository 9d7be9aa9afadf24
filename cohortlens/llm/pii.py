"""Personal data: exact patterns and a trained character tagger that adds spans."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import span_tagger
from cohortlens.llm.common import slices, table
from cohortlens.llm.span_tagger import KINDS, WINDOW, Tagger

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The look-behind changes no match (a run of digits fails from its start or not at all) and
#: keeps long runs from being tried at every digit.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BLANK = re.compile(r"\s")
ANCHOR = re.compile(r"[0-9@](?:[^0-9@]{0,40}[0-9@])*")
#: Characters of context on either side of digits and at signs, and bounds of the training sample.
CONTEXT = 24
SAMPLE_DOCS, WINDOWS_PER_DOC, SAMPLE_WINDOWS = 8000, 6, 4000
ORDER = {kind: k for k, kind in enumerate(KINDS)}
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def small_parts(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def emails(text: str) -> Iterator[Span]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ found from the at sign, as a
    long run of letters without one would be tried from every letter."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the exact patterns, by start and kind."""
    out = list(emails(text))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in IP.finditer(text):
        if small_parts(m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def regions_of(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at signs, which every kind holds; nothing else can be a span. A
    stretch goes on to the ends of the words that it reaches into."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        low, high = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and high <= out[-1][1]:
            continue
        floor = out[-1][0] if out else 0
        while low > floor and not text[low - 1].isspace():
            low -= 1
        blank = BLANK.search(text, high)
        high = blank.start() if blank else len(text)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def plausible(kind: str, value: str) -> bool:
    """Whether a span of the tagger has the digits its kind needs; spacing and signs are free."""
    digits = digits_of(value)
    if kind == "email":
        sides = value.split("@")
        return len(sides) == 2 and bool(sides[0].strip()) and bool(
            re.fullmatch(r"\s?[^\s@.]+(\s?\.\s?[^\s@.]+)+", sides[1]))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\s?\.\s?[0-9]{1,3}){3}", value)) and small_parts(
            re.findall("[0-9]+", value))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 ./_-]", value)
    return 10 <= len(digits) <= 15 and bool(
        re.fullmatch(r"(\+|00)?\s?\(?[0-9]{1,4}\)?([ ./-]{0,2}\(?[0-9]{2,8}\)?){2,5}", value))


def added_spans(texts: list[str], base: list[list[Span]], model: Tagger | None) -> list[list[Span]]:
    """Spans of the tagger that pass `plausible` and touch no base span or earlier added one."""
    out: list[list[Span]] = [[] for _ in texts]
    if model is None:
        return out
    places = [(k, low, high) for k, text in enumerate(texts) for low, high in regions_of(text)]
    for start in range(0, len(places), 512):
        some = places[start:start + 512]
        found = span_tagger.decode(model, [texts[k][low:high] for k, low, high in some])
        for (k, low, _), spans in zip(some, found):
            for kind, a, b in spans:
                value = texts[k][low + a:low + b]
                a, b = low + a + len(value) - len(value.lstrip()), low + a + len(value.rstrip())
                clear = all(b <= s or e <= a for _, s, e in base[k] + out[k][-8:])
                inner = (a == 0 or not texts[k][a - 1].isalnum()) and (
                    b == len(texts[k]) or not texts[k][b].isalnum())
                if clear and inner and plausible(kind, texts[k][a:b]):
                    out[k].append((kind, a, b))
    return out


def labelled_windows(docs: DataFrame, text: str) -> list[tuple[str, list[Span]]]:
    """Windows with the spans of the exact patterns in them, of a bounded sample of documents
    drawn at random: some around spans, some around other digits and at signs."""
    n = docs.count()
    # drawn row by row, so that a repeated or missing id is no more likely than others
    some = docs.where(F.rand(17) * n < SAMPLE_DOCS).select(F.col(text).alias("text")).where(
        "text is not null").limit(2 * SAMPLE_DOCS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts, labels = [], []
            for value in batch.column(0).to_pylist():
                spans, rng = base_spans(value), random.Random(len(value))
                places = [max(0, a - rng.randrange(max(1, WINDOW - (b - a)))) for _, a, b in spans]
                near = [rng.randrange(low, max(low + 1, high - WINDOW + 1)) for low, high in regions_of(value)]
                for start in [k for own in (places, near)
                              for k in rng.sample(own, min(len(own), WINDOWS_PER_DOC))]:
                    parts.append(value[start:start + WINDOW])
                    labels.append(written([
                        (k, max(a, start) - start, min(b, start + WINDOW) - start)
                        for k, a, b in spans if a < start + WINDOW and b > start]))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(labels, pa.string())],
                                             names=["part", "labels"])

    rows = sorted({(r["part"], r["labels"]) for r in
                   some.mapInArrow(cut, "part string, labels string").collect()})
    random.Random(23).shuffle(rows)
    return [(part, [(k, int(a), int(b)) for k, a, b in
                    (s.split(":") for s in labels.split(",") if s)]) for part, labels in rows[:SAMPLE_WINDOWS]]


def varied(part: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """The window with its spans written in other ways, the labels moved along."""
    out, labels, at = [], [], 0
    length = 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        value = part[a:b]
        if kind == "phone":
            value = value.replace("+", "", 1).strip() if rng.random() < 0.5 else value
            value = value.replace("-", rng.choice("-. /"))
        elif kind == "card":
            sign = rng.choice(["", " ", "-", ".", "/"])
            value = sign.join(digits_of(value)[k:k + 4] for k in range(0, len(digits_of(value)), 4))
        elif kind == "email":
            value = value.replace("@", rng.choice(["@", " @ ", " @"]))
        else:
            value = value.replace(".", rng.choice([".", " . ", ". "]))
        out += [part[at:a], value]
        length += a - at
        labels.append((kind, length, length + len(value)))
        length += len(value)
        at = b
    return "".join([*out, part[at:]]), labels


def plain_numbers(part: str, rng: random.Random) -> tuple[str, list[Span]]:
    """A window without spans into which dates, amounts and versions are set: none of them counts."""
    value = rng.choice([
        f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}",
        f"{rng.randrange(1, 10 ** 7):,}.{rng.randrange(100):02}", str(rng.randrange(10 ** 12)),
        f"{rng.randrange(24):02}:{rng.randrange(60):02}", f"v{rng.randrange(9)}.{rng.randrange(20)}",
        f"{rng.randrange(2000)}/{rng.randrange(100)}", f"@{part[:4].strip()}"])
    at = rng.randrange(max(1, len(part) - 30))
    return part[:at] + " " + value + " " + part[at:], []


def fit(docs: DataFrame, text: str = "text") -> Tagger | None:
    """A tagger for `docs`; None where the sample holds no span to learn from."""
    windows = labelled_windows(docs, text)
    rng = random.Random(31)
    held = [w for w in windows if w[1]]
    clean = [w for w in windows if not w[1]]
    if not held:
        return None
    texts = clean or [(re.sub("[0-9@]", "", p), []) for p, _ in held]
    made = [varied(*rng.choice(held), rng) for _ in range(len(held))]
    made += [plain_numbers(rng.choice(texts)[0], rng) for _ in range(len(held) // 2 + 50)]
    return span_tagger.train(held + clean[:2 * len(held) + 200] + made)


def find(docs: DataFrame, model: Tagger | None, text: str = "text") -> DataFrame:
    """`docs` with base_spans and all_spans: arrays of struct(kind, start, end) in code points, the
    end exclusive (columns of these names are replaced). Rows are judged one by one in whole texts;
    null text holds nothing."""
    names = [c for c in docs.columns if c not in ("base_spans", "all_spans")]
    kept, at = docs.select(*names), names.index(text)
    kind = "array<struct<kind:string,start:int,end:int>>"
    schema = kept.selectExpr("*", f"cast(null as {kind}) base_spans", f"cast(null as {kind}) all_spans").schema
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [in_order(b + a) for b, a in zip(base, added_spans(texts, base, model))]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in own] for own in side], arrow)
                       for side in (base, every)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns],
                                             names=[*names, "base_spans", "all_spans"])

    return kept.mapInArrow(tag, schema)


def redact(docs: DataFrame, model: Tagger | None, text: str = "text") -> DataFrame:
    """`docs` with every span of `text` replaced by its kind in angle brackets; spans that overlap
    are replaced together under the kind of the first. Null stays null."""
    names = docs.columns
    at = names.index(text)

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            plain = [t or "" for t in texts]
            base = [base_spans(t) for t in plain]
            out = []
            for given, value, own, more in zip(texts, plain, base, added_spans(plain, base, model)):
                parts, done = [], 0
                for kind, start, end in in_order(own + more):
                    if start >= done:
                        parts += [value[done:start], f"<{kind.upper()}>"]
                    done = max(done, end)
                out.append(given if not parts else "".join([*parts, value[done:]]))
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(hide, docs.schema)


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, base and all spans to the columns of the query."""
    for batch in batches:
        docs, base, every = (c.to_pylist() for c in batch.columns)
        lists = [[[(s["kind"], s["start"], s["end"]) for s in own] for own in side] for side in (base, every)]
        counts = [[sum(s[0] == kind for s in own) for own in lists[0]] for kind in KINDS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
             pa.array([hashlib.sha256(written(own).encode()).hexdigest() for own in lists[0]], pa.string()),
             pa.array([written(own) for own in lists[1]], pa.string())],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs)).select("doc_id", "base_spans", "all_spans")
    return found.mapInArrow(digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                            "base_sha256 string, spans string")
