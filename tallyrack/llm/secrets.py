"""Secret scans (operator 6): fixed patterns, and a character convolutional network over every other candidate.

The patterns' findings always stay.  Candidates are runs of key characters outside of these that mix letters, digits or
capitals, are long and various, or stand where an address has a password; digits alone of up to 19, as cards and accounts
have them, are numbers and no keys.  The network reads each candidate with the text around it.  It is trained on labelled
findings: what the patterns find and what is plainly an address, a host or a number in all texts, and generated keys and
harmless strings.  It starts from the generated ones; then partitions take steps over all findings of the corpus and
their networks are averaged.  Its scores are calibrated on a quarter of both that it didn't learn from, and the threshold
is the greatest that keeps the recall asked for.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, documents, release, slices, table, texts
from .convnet import ByteConvNet, learn

KINDS = ("assign", "access", "hex", "model")
#: The contract's patterns; on bytes, letters ignore case for ASCII alone.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
#: A whole run that has a digit, a capital after a small letter, or 16 characters; lower-case words are passed over.
_RUN = re.compile(rb"(?<![A-Za-z0-9+/_.=-])(?:[A-Za-z+/_.=-]*+[0-9][A-Za-z0-9+/_.=-]*+|[A-Za-z+/_.=-]{16,}+|(?=[A-Za-z]*[a-z][A-Z])[A-Za-z+/_.=-]{6,}+)")
_INNER = re.compile(rb"[a-z][A-Z]")
#: Where an address has a password, whatever it is made of.
_LOGIN = re.compile(rb"(?<=:)[A-Za-z0-9+_.=-]{6,}+(?=@)")
#: Characters of a candidate, at least; of letters alone; of digits alone; and how many kinds the last two have.
SHORT, LONG, DIGITS, VARIETY = 6, 16, 20, 6
_NAMES = (b"passw", b"secret", b"token", b"api")
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Bytes of context on either side, and of a candidate under one window; longer ones have several, half overlapping.
CONTEXT, BODY = 16, 64
LENGTH = BODY + 2 * CONTEXT
#: So many findings are generated.  In steps and in calibration the corpus's count half as much as they do, at most.
GENERATED = 8000
#: Rates of the rounds over the corpus's findings.
RATES = (0.003, 0.001)
#: Scores' logits are counted by this part of one.
STEP = 1 / 256
RECALL = 0.99
#: Labels.
HARMLESS, KEY = range(2)
#: Candidates that are scored at a time.
GROUP = 2048


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, ordered by start, then kind."""
    out = []
    lower = text.translate(_LOWER)
    if any(name in lower for name in _NAMES):
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def candidates(text: bytes, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of key characters, or what base spans leave of them, that may be keys (`_may_be`), whatever is around them."""
    out, k, spans = [], 0, sorted((a, b) for a, b, _ in taken)
    for m in _RUN.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        j = k
        while j < len(spans) and spans[j][0] < b:
            if spans[j][0] > a and _may_be(text, a, spans[j][0]):
                out.append((a, spans[j][0]))
            a, j = max(a, spans[j][1]), j + 1
        if a < b and _may_be(text, a, b):
            out.append((a, b))
    if b"://" in text:
        ours = sorted(out)
        logins = [m.span() for m in _LOGIN.finditer(text)]
        free = [(a, b) for a, b in logins if not _touched(spans, a, b)]
        out = [c for c in ours if not _touched(free, *c)] + free
    return sorted(out)


def _touched(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of some sorted spans that don't overlap shares a byte with another."""
    i = bisect_right(spans, (a, 1 << 62)) - 1
    return any(s < b and e > a for s, e in spans[max(0, i) : i + 2])


def _may_be(text: bytes, a: int, b: int) -> bool:
    """SHORT or more characters with a letter and a digit; or letters alone, LONG or more, or digits alone, DIGITS or
    more, of VARIETY kinds; or SHORT letters or more with a capital after a small one."""
    if b - a < SHORT:
        return False
    if _DIGIT.search(text, a, b):
        if _LETTER.search(text, a, b):
            return True
        return len(_DIGIT.findall(text, a, b)) >= DIGITS and len(set(text[a:b])) >= VARIETY
    elif _INNER.search(text, a, b):
        return True
    return b - a >= LONG and len(set(text[a:b])) >= VARIETY


def windows(text: bytes, start: int, end: int) -> bytes:
    """One or more windows of LENGTH bytes for a candidate.  Context bytes have the high bit set, so that the network
    tells them from the candidate's own."""
    before = bytes(128 | min(c, 127) for c in text[max(0, start - CONTEXT) : start]).rjust(CONTEXT, b"\0")
    after = bytes(128 | min(c, 127) for c in text[end : end + CONTEXT]).ljust(CONTEXT, b"\0")
    steps = range(0, max(1, end - start - BODY // 2), BODY // 2)
    return b"".join(before + text[start + k : min(end, start + k + BODY)].ljust(BODY, b"\0") + after for k in steps)


def _value(text: bytes, span: tuple[int, int, int]) -> tuple[int, int]:
    """The secret itself: an assignment's value, else the whole span."""
    if span[2] == 0:
        m = _ASSIGN.match(text, span[0])
        return m.span(2)
    return span[:2]


def harmless(text: bytes, start: int, end: int) -> bool:
    """Plainly no secret: beside an @ (but not between : and @, where passwords are), or dotted words as hosts, dates
    and numbers have them."""
    run = text[start:end]
    if text[start - 1 : start] == b":" and text[end : end + 1] == b"@":
        return False
    if text[start - 1 : start] == b"@" or text[end : end + 1] == b"@":
        return True
    return bool(re.fullmatch(rb"(?:[A-Za-z]*[0-9]{0,4}[./_=-])+[A-Za-z]*[0-9]{0,4}", run) or (re.fullmatch(rb"[0-9.,+/_=-]+", run) and not run.isdigit()))


def _labelled(text: bytes) -> Iterator[tuple[int, int, int]]:
    """What needs no network to be told: the patterns' secrets, and candidates that are plainly harmless."""
    spans = base_spans(text)
    yield from ((*_value(text, s), KEY) for s in spans)
    yield from ((a, b, HARMLESS) for a, b in candidates(text, spans) if harmless(text, a, b))


def findings(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, start, label, weight, window), one row for each window of a labelled finding, which together
    weigh one.  Null and empty texts, and an empty table, have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "label", "weight", "window"])

        release()
        for part in slices(batches):
            rows: list[tuple] = []
            for doc, text in zip(part.column("doc_id").cast(pa.int64()).to_pylist(), texts(part.column("text")), strict=True):
                for a, b, label in _labelled(text):
                    w = windows(text, a, b)
                    for i in range(0, len(w), LENGTH):
                        rows.append((doc, a, label, LENGTH / len(w), w[i : i + LENGTH]))
                        if len(rows) >= 1 << 14:
                            yield out(rows)
                            rows = []
            yield out(rows)

    return documents(docs, "doc_id", "text").mapInArrow(run, "doc_id long, start long, label int, weight double, window binary")


def _places(text: bytes, offsets: list[int]) -> dict[int, int]:
    """Byte offsets -> code points, in one pass."""
    out, at, points = {}, 0, 0
    for x in sorted(set(offsets)):
        points += len(text[at:x].decode("utf-8", "replace"))
        out[x], at = points, x
    return out


def generated(n: int, seed: int = 11) -> list[tuple[bytes, int]]:
    """Windows of n generated findings and their labels: random keys of several shapes, and harmless strings, planted
    in texts and found there as those of documents are."""
    r = random.Random(seed)
    letters, word = string.ascii_letters, lambda: "".join(r.choices(string.ascii_lowercase, k=r.randint(2, 10)))
    draw = lambda alphabet, low, high: "".join(r.choices(alphabet, k=r.randint(low, high)))
    leet = str.maketrans("aeiost", "431057")
    keys = [
        lambda: draw(letters + string.digits, 8, 20), lambda: draw(letters, 4, 8) + draw(string.digits, 1, 3) + draw(letters, 3, 8), lambda: draw(letters, 16, 32), lambda: draw(string.digits, 20, 40),
        lambda: (word() + word() + "pass").translate(leet) + draw(letters + string.digits, 2, 6), lambda: draw(letters + string.digits, 8, 16) + draw(string.digits + "abcdef", 24, 32) + "G" + draw(letters + string.digits, 8, 16),
        lambda: draw(letters + string.digits, 20, 44), lambda: draw(letters + string.digits + "+/", 24, 64) + r.choice(["", "=", "=="]),
        lambda: draw(string.digits + "abcdef", 16, 64), lambda: draw(string.ascii_uppercase + string.digits, 16, 32),
        lambda: draw(string.ascii_lowercase, 2, 4) + r.choice("_-") + draw(letters + string.digits, 20, 40), lambda: ".".join(draw(letters + string.digits + "_-", 16, 40) for _ in range(3)),
    ]
    plain = [
        lambda: f"{word()}.{r.randint(0, 99)}.{word()}{r.randint(0, 9)}.example.com", lambda: f"mail{r.randint(0, 99)}.{word()}.{r.choice(['com', 'org', 'net'])}",
        lambda: f"{r.randint(1900, 2100)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}", lambda: "-".join(word() for _ in range(r.randint(2, 4))) + str(r.randint(0, 99)),
        lambda: "/".join(word() for _ in range(r.randint(2, 5))) + f"/{word()}{r.randint(0, 9)}.html", lambda: "_".join(word() for _ in range(r.randint(2, 4))) + f"_v{r.randint(1, 9)}",
        lambda: word() + word() + word() + str(r.randint(0, 2100)), lambda: f"{word()}-{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}.tar.gz",
        lambda: "".join(word().title() for _ in range(3)) + str(r.randint(0, 99)), lambda: word() + str(r.randint(0, 9999)), lambda: word().title() + str(r.randint(0, 99)),
        lambda: word() + word().title(), lambda: f"{word()}.{r.randint(0, 99)}", lambda: f"{word()}_{word()}{r.randint(0, 99)}", lambda: f"{word()}.{word()}.{r.randint(0, 99)}", lambda: "".join(word() for _ in range(3)).upper(), lambda: f"{r.randint(1, 999)}{r.choice(['px', 'km', 'GB', 'th', 'mg'])}-{word()}", lambda: "-".join(word() for _ in range(r.randint(3, 6))), lambda: "".join(word() for _ in range(r.randint(3, 4))),
    ]
    out = []
    for _ in range(n):
        label = r.choice([HARMLESS, KEY])
        body = r.choice([plain, keys][label])()
        before = r.choice(["", " ", "\n", f"{word()} ", f"{word()} {word()}=", f"{word()}: ", '"', "key = '", *[f"{word()[:4]}://{word()}:"] * 3 * (label == KEY)] if label or r.random() < 0.2 else ["", " ", f"{word()} ", f"{word()}. ", f"{word()}@", "see ", "write to ", f"{word()}: ", f"{word()}://"])
        if "://" in before and label == KEY and r.random() < 0.25:  # there any word is a password
            body = (word() + word())[: r.randint(6, 15)].ljust(6, "x")
        after = f"@{word()}" if "://" in before and label == KEY else r.choice(["", " ", "\n", f" {word()} {word()}", '"', "."] + [f"@{word()}{r.randint(0, 99)}.{word()}.com"] * (4 * (label == HARMLESS)))
        text = (before + body + after).encode()
        for a, b in candidates(text, base_spans(text)):
            if a < len(before) + len(body) and b > len(before):
                w = windows(text, a, b)
                out += [(w[i : i + LENGTH], label) for i in range(0, len(w), LENGTH)]
    return out


class SecretModel:
    def __init__(self, net: ByteConvNet, slope: float, shift: float, threshold: float) -> None:
        self.net, self.slope, self.shift, self.threshold, self.tables = net, slope, shift, threshold, net.tables()
        #: Windows of the corpus that it has learned from.
        self.learned = 0

    def _raw(self, data: bytes) -> np.ndarray:
        n = len(data) // LENGTH
        p = self.net.predict(np.frombuffer(data + b"\0" * self.net.ahead, np.uint8), n, self.tables)[:, 1].astype(float)
        return np.log(np.clip(p, 1e-7, 1) / np.clip(1 - p, 1e-7, 1))

    def found(self, text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Those of a text's candidates that are keys; GROUP of them are looked at at a time."""
        out = []
        for i in range(0, len(spans), GROUP):
            own = spans[i : i + GROUP]
            out += [c for c, p in zip(own, self.scores([windows(text, *c) for c in own]), strict=True) if p >= self.threshold]
        return out

    def scores(self, items: list[bytes]) -> np.ndarray:
        """A calibrated probability for each candidate to be a key, the greatest of its windows."""
        if not items:
            return np.zeros(0)
        ends = np.cumsum([len(x) // LENGTH for x in items])
        raw = np.maximum.reduceat(self._raw(b"".join(items)), np.concatenate([[0], ends[:-1]]))
        return 1 / (1 + np.exp(-(self.slope * raw + self.shift)))


def _started(pairs: list[tuple[bytes, int]], seed: int) -> tuple[ByteConvNet, np.ndarray, np.ndarray, np.ndarray]:
    """A network that has learned from three quarters of some windows; windows, labels, and which it didn't learn from."""
    x = np.frombuffer(b"".join(w for w, _ in pairs), np.uint8).reshape(-1, LENGTH)
    y = np.array([k for _, k in pairs])
    held = np.zeros(len(y), bool)
    order = np.random.default_rng(seed).permutation(len(y))
    held[order[::4]] = True
    own = np.delete(order, np.s_[::4])
    net = ByteConvNet(2, LENGTH, widths=(2, 3, 5), filters=24, seed=6)
    net.fit(np.pad(x[own], ((0, 0), (0, net.ahead))), y[own], epochs=8)
    return net, x, y, held


def _calibrated(model: SecretModel, z: np.ndarray, t: np.ndarray, weight: np.ndarray, recall: float) -> SecretModel:
    """Slope, shift and threshold by logits of windows it didn't learn from, their labels and weights."""
    n = weight.sum()
    for _ in range(50):  # Newton steps of a logistic fit in one variable
        p = 1 / (1 + np.exp(-(model.slope * z + model.shift)))
        g = np.array([((p - t) * z * weight).sum() / n + 1e-3 * (model.slope - 1), ((p - t) * weight).sum() / n])
        v = p * (1 - p) * weight / n
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        model.slope, model.shift = model.slope - float(np.clip(step[0], -1, 1)), model.shift - float(np.clip(step[1], -1, 1))
    score, own = 1 / (1 + np.exp(-(model.slope * z[t == 1] + model.shift))), weight[t == 1]
    order = np.argsort(score, kind="stable")
    reached = np.cumsum(own[order])
    model.threshold = float(score[order][np.searchsorted(reached, (1 - recall) * reached[-1], side="right")]) if len(score) else 1.0
    return model


def fit(pairs: list[tuple[bytes, int]], recall: float = RECALL, seed: int = 5) -> SecretModel:
    """pairs: windows and labels.  A quarter of them calibrates and sets the threshold."""
    net, x, y, held = _started(pairs, seed)
    model = SecretModel(net, 1.0, 0.0, 0.5)
    return _calibrated(model, model._raw(x[held].tobytes()), (y[held] == KEY).astype(int), np.ones(held.sum()), recall)


def logits(held: DataFrame, model: SecretModel) -> DataFrame:
    """findings -> (label, step, weight): how much the windows weigh whose logit is `step` whole STEPs, over all of them."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(at, GROUP) for b in batches for at in range(0, b.num_rows, GROUP)):
            z = shared.value._raw(b"".join(v.as_py() for v in part.column("window")))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(np.floor(z / STEP).astype(np.int32)), part.column("weight")], names=["label", "step", "weight"])

    return held.mapInArrow(run, "label int, step int, weight double").groupBy("label", "step").agg(F.sum("weight").alias("weight"))


def train(found: DataFrame, recall: float = RECALL) -> SecretModel:
    """Learns from all labelled findings and GENERATED ones.  What the driver gets is a sum of networks, and how many of
    the held findings' windows each STEP of logits has."""
    found = checkpoint(found.withColumn("held", F.pmod(F.xxhash64("doc_id", "start", F.lit("held")), F.lit(4)) == 0))
    net, x, y, held = _started(generated(GENERATED), 5)
    padded = np.pad(x[~held], ((0, 0), (0, net.ahead)))
    rows = found.filter(~F.col("held")).select("label", "weight", F.concat("window", F.lit(bytes(net.ahead))).alias("window"))
    learned = learn(rows, net, RATES, (padded, y[~held]))
    model = SecretModel(net, 1.0, 0.0, 0.5)
    model.learned = learned
    counts = logits(found.filter("held"), model).orderBy("label", "step").collect()
    total = sum(r.weight for r in counts)
    share = min(1.0, held.sum() / 2 / total) if total else 1.0
    z = np.concatenate([model._raw(x[held].tobytes()), [r.step * STEP for r in counts]])
    t = np.concatenate([y[held] == KEY, [r.label == KEY for r in counts]]).astype(int)
    return _calibrated(model, z, t, np.concatenate([np.ones(held.sum()), [r.weight * share for r in counts]]), recall)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def spans(docs: DataFrame, model: SecretModel) -> DataFrame:
    """documents -> (doc_id, n_assign, n_access, n_hex, n_model, base_sha256, spans), in code points, one row for each
    row.  Null and empty texts have no span; a very long text's candidates are scored GROUP at a time; no row, no result."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches):
            items = list(texts(part.column("text")))
            base = [base_spans(x) for x in items]
            keys = _keys(items, base, model)
            rows = []
            for text, own, more in zip(items, base, keys, strict=True):
                at = _places(text, [x for s in own for x in s[:2]] + [x for s in more for x in s])
                own = [(at[a], at[b], k) for a, b, k in own]
                more = [(at[a], at[b], 3) for a, b in more]
                of = [sum(k == j for _, _, k in own) for j in range(3)]
                rows.append((*of, len(more), hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(own + more)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            names = ["n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    return documents(docs, "doc_id", "text").mapInArrow(run, schema)


def _keys(items: list[bytes], base: list[list[tuple]], model: SecretModel) -> list[list[tuple[int, int]]]:
    """Each text's keys.  Texts with few candidates share a pass of the network, others are looked at by themselves."""
    own = [candidates(x, b) for x, b in zip(items, base, strict=True)]
    out: list[list[tuple[int, int]]] = [[] for _ in items]
    group: list[int] = []
    held = 0

    def flush() -> None:
        score = iter(model.scores([windows(items[i], *c) for i in group for c in own[i]]).tolist())
        for i in group:
            out[i] = [c for c in own[i] if next(score) >= model.threshold]

    for i, spans_ in enumerate(own):
        if len(spans_) > GROUP:
            out[i] = model.found(items[i], spans_)
            continue
        if held + len(spans_) > GROUP:
            flush()
            group, held = [], 0
        group.append(i)
        held += len(spans_)
    flush()
    return out


def scan(docs: DataFrame) -> DataFrame:
    """documents -> their spans.  Null and empty texts have none; repeated rows are scanned each."""
    return spans(docs, train(findings(docs)))


def redact(docs: DataFrame, model: SecretModel, mark: str = "[SECRET]") -> DataFrame:
    """documents with every span in text replaced by the mark and n_chars, if it is there, set anew; other columns and all
    rows stay, null and empty texts as they are.  An empty table gives an empty one."""
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for part in slices(batches):
            items = list(texts(part.column("text")))
            base = [base_spans(x) for x in items]
            clean = []
            for x, b, more, null in zip(items, base, _keys(items, base, model), part.column("text").is_null().to_pylist(), strict=True):
                pieces, at = [], 0
                for start, end in sorted([(s, e) for s, e, _ in b] + more):
                    if start >= at:
                        pieces += [x[at:start], mark.encode()]
                    at = max(at, end)
                clean.append(None if null else b"".join([*pieces, x[at:]]).decode("utf-8", "replace"))
            columns = dict(zip(names, part.columns, strict=True)) | {"text": pa.array(clean, pa.string())}
            if "n_chars" in names:
                columns["n_chars"] = pa.array([None if c is None else len(c) for c in clean], part.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return docs.mapInArrow(run, schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
