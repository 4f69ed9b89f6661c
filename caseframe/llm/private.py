"""Personal data: exact patterns, and a character tagger that adds what they miss.

The tagger is a bidirectional LSTM over characters with CRF transitions between tags, in numpy. It
is trained from labelled spans: windows of a bounded sample of texts, whose spans are those of the
patterns, and the same windows with other separators, spaces and prefixes within the labelled spans. Texts are read in overlapping windows. Each
position takes its scores from the window in which it stands farthest from an edge, and one Viterbi
pass decodes all windows of a stretch together. A span needs a digit or an @, so the LSTM
is run on windows with one of them and on their neighbours.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm.credentials import SPANS, _SPANS
from caseframe.llm.shared import ship

# The kinds, in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    """Leftmost matches; each @ is looked at once, so long words cost no more than their length."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(last, at + 1))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the pattern matches, in code points, by start and then kind."""
    found = [("email", *span) for span in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if 14 <= len(digits := _digits(m[0])) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


#: Size of the tagger, and the bounds of its sample: rows with a digit or an @ and rows of any kind,
#: and their characters.
EMBED, HIDDEN = 10, 14
SAMPLE_ROWS, SAMPLE_CHARS, TRAIN_WINDOWS = 800, 20_000, 1000
WINDOW, STRIDE, TRAIN_WINDOW = 128, 96, 64
#: Updates in all, so that a small sample is gone through more often.
UPDATES, BATCH, RATE = 400, 64, 0.02
#: Rewritten copies of a text at most; fewer if the sample has many spans.
COPIES = 6
#: Mean posterior that an added span needs.
SURE = 0.9
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
SYMBOLS = 130


class Tagger(NamedTuple):
    embed: np.ndarray   # symbols x EMBED
    inward: np.ndarray  # 2 x EMBED x 4 HIDDEN
    again: np.ndarray   # 2 x HIDDEN x 4 HIDDEN
    shift: np.ndarray   # 2 x 4 HIDDEN
    out: np.ndarray     # 2 HIDDEN x TAGS
    level: np.ndarray   # TAGS
    moves: np.ndarray   # TAGS x TAGS


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, points, 128).astype(np.int64)


def _squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(model: Tagger, codes: np.ndarray, side: int, keep_steps: bool = False):
    """Hidden states of one direction (windows x positions x HIDDEN), and what training needs."""
    table = model.embed @ model.inward[side] + model.shift[side]
    h = np.zeros((len(codes), HIDDEN), np.float32)
    c, states, steps = h, np.empty((*codes.shape, HIDDEN), np.float32), []
    order = range(codes.shape[1]) if side == 0 else range(codes.shape[1] - 1, -1, -1)
    for t in order:
        gates = table[codes[:, t]] + h @ model.again[side]
        three, candidate = _squash(gates[:, :3 * HIDDEN]), np.tanh(gates[:, 3 * HIDDEN:])
        i, f, o = np.split(three, 3, axis=1)
        before, old = h, c
        c = f * old + i * candidate
        shown = np.tanh(c)
        h = o * shown
        states[:, t] = h
        if keep_steps:
            steps.append((t, i, f, o, candidate, old, shown, before))
    return (states, steps) if keep_steps else states


def scores(model: Tagger, codes: np.ndarray) -> np.ndarray:
    both = np.concatenate([_run(model, codes, 0), _run(model, codes, 1)], axis=2)
    return both @ model.out + model.level


def _allowed() -> np.ndarray:
    """Inside follows begin or inside of its kind only."""
    grid = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        grid[:, 2 + 2 * k] = -1e4
        grid[1 + 2 * k, 2 + 2 * k] = grid[2 + 2 * k, 2 + 2 * k] = 0
    return grid


_GRID = _allowed()


def marginals(unary: np.ndarray, moves: np.ndarray):
    """Posteriors of tags and expected pairs of chains of equal length."""
    count, steps, width = unary.shape
    local = np.exp(unary - unary.max(axis=2, keepdims=True))
    local[:, 0, 2::2] = 1e-12
    move = np.exp(np.maximum(moves + _GRID, -60))
    forward, state = np.empty_like(local), None
    for t in range(steps):
        state = local[:, t] * (state @ move if t else 1)
        state = state / state.sum(axis=1, keepdims=True)
        forward[:, t] = state
    out, later, expected = np.empty_like(local), np.ones((count, width)), np.zeros((width, width))
    for t in range(steps - 1, -1, -1):
        both = forward[:, t] * later
        out[:, t] = both / both.sum(axis=1, keepdims=True)
        if t:
            ahead = local[:, t] * later
            joint = forward[:, t - 1, :, None] * move * ahead[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            later = ahead @ move.T
            later /= later.sum(axis=1, keepdims=True)
    return out, expected


def fit(codes: np.ndarray, tags: np.ndarray, seed: int = 3) -> Tagger:
    """Train on windows (windows x positions) of symbols and tags, by Adam on the CRF likelihood."""
    random = np.random.default_rng(seed)
    small = lambda *shape: (random.standard_normal(shape) * 0.2).astype(np.float32)
    model = Tagger(small(SYMBOLS, EMBED), small(2, EMBED, 4 * HIDDEN), small(2, HIDDEN, 4 * HIDDEN),
                   np.zeros((2, 4 * HIDDEN), np.float32), small(2 * HIDDEN, TAGS),
                   np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))
    model.shift[:, HIDDEN:2 * HIDDEN] = 1
    first = [np.zeros(p.shape) for p in model]
    second = [np.zeros(p.shape) for p in model]
    turn = 0
    batches = max(1, len(codes) // BATCH)
    for _ in range(-(-UPDATES // batches) if len(codes) else 0):
        for part in np.array_split(random.permutation(len(codes)), batches):
            turn += 1
            for p, g, a, b in zip(model, _slopes(model, codes[part], tags[part]), first, second):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p += (RATE * (a / (1 - 0.9 ** turn))
                      / (np.sqrt(b / (1 - 0.99 ** turn)) + 1e-8)).astype(np.float32)
    return model


def _sums(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows added up by symbol."""
    order = np.argsort(codes, kind="stable")
    found, at = np.unique(codes[order], return_index=True)
    table = np.zeros((SYMBOLS, rows.shape[1]))
    table[found] = np.add.reduceat(rows[order], at, axis=0)
    return table


def _slopes(model: Tagger, codes: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    """Gradient of the mean log likelihood for each array of the model."""
    runs = [_run(model, codes, side, True) for side in (0, 1)]
    both = np.concatenate([runs[0][0], runs[1][0]], axis=2)
    posterior, expected = marginals(both @ model.out + model.level, model.moves)
    error = (np.eye(TAGS)[tags] - posterior) / len(codes)
    seen = np.zeros((TAGS, TAGS))
    np.add.at(seen, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    back = error @ model.out.T
    embed, inward = np.zeros_like(model.embed), np.zeros_like(model.inward)
    again, shift = np.zeros_like(model.again), np.zeros_like(model.shift)
    for side, (_, steps) in enumerate(runs):
        dh = dc = np.zeros((len(codes), HIDDEN))
        every = np.empty((*codes.shape, 4 * HIDDEN), np.float32)
        for t, i, f, o, candidate, old, shown, before in reversed(steps):
            dh = dh + back[:, t, side * HIDDEN:(side + 1) * HIDDEN]
            dc = dc + dh * o * (1 - shown ** 2)
            gates = np.concatenate([dc * candidate * i * (1 - i), dc * old * f * (1 - f),
                                    dh * shown * o * (1 - o), dc * i * (1 - candidate ** 2)], axis=1)
            every[:, t] = gates
            again[side] += before.T @ gates
            shift[side] += gates.sum(axis=0)
            dh, dc = gates @ model.again[side].T, dc * f
        table = _sums(codes.ravel(), every.reshape(-1, 4 * HIDDEN))
        inward[side] = model.embed.T @ table
        embed += (table @ model.inward[side].T).astype(np.float32)
    clip = lambda g: np.clip(g, -5, 5)
    return [*map(clip, (embed, inward, again, shift, both.reshape(-1, 2 * HIDDEN).T
                        @ error.reshape(-1, TAGS), error.sum(axis=(0, 1)),
                        (seen - expected) / len(codes)))]


def _redrawn(span: str, random) -> str:
    """The span with other digits and, mostly, other letters, so that no name or host is learnt by heart."""
    letters = random.random() < 0.7
    draw = lambda m: (str(random.integers(10)) if m[0].isdigit() else
                      chr(97 + int(random.integers(26))) if letters else m[0])
    return re.sub("[0-9a-z]", draw, span)


def varied(kind: str, span: str, random) -> str:
    """A span of a kind as it is also written, mostly so that the patterns miss it."""
    pick = lambda *some: some[int(random.integers(len(some)))]
    span = _redrawn(span, random)
    if kind == "email":
        name, host = span.rsplit("@", 1)
        name = pick(name, re.sub("[^A-Za-z]", "", name) or name, re.sub("[^A-Za-z0-9]", "", name) or name)
        at = pick(" @ ", " @", "@ ", " [@] ", "(@)")
        return name + at + host.replace(".", pick(".", ".", " . "))
    if kind == "ip":
        return span.replace(".", pick(" . ", "-", ",", ". ", " ."))
    digits = _digits(span)
    if kind == "card":
        mark = pick(".", "  ", " - ", "/", "_")
        return mark.join(digits[k:k + 4] for k in range(0, len(digits), 4))
    mark = pick(" ", "-", ".", "/", "  ", "")
    head, rest = digits[:-10] or digits[:2], digits[-10:] if len(digits) > 10 else digits[2:]
    form = mark.join((rest[:3], rest[3:6], rest[6:]))
    bare = pick(mark if mark.strip() else "-", "-")
    alone = f"{rest[:3]}{pick(' ', bare)}{rest[3:6]}{bare}{rest[6:]}"
    form, alone = pick((form, alone), (f"({rest[:3]}) {rest[3:6]}{mark or '-'}{rest[6:]}",) * 2)
    # Groups with nothing but spaces between them are also counts, so they have a prefix here.
    return pick(alone, *(head + form for head in (
        f"{head}{mark or ' '}", f"{head} ", f"00{head} ", f"00 {head} ", f"+ {head} ")))


def rewritten(text: str, spans: list[tuple[str, int, int]], random) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its spans written otherwise, and where they are then. Spans that overlap an earlier one go."""
    parts, out, last, length = [], [], 0, 0
    for kind, start, end in spans:
        if start < last:
            continue
        other = varied(kind, text[start:end], random)
        length += start - last
        parts += [text[last:start], other]
        out.append((kind, length, length + len(other)))
        length, last = length + len(other), end
    return "".join([*parts, text[last:]]), out


def training_windows(texts: list[str], random) -> tuple[np.ndarray, np.ndarray]:
    """Windows around labelled spans and elsewhere, with begin and inside tags."""
    codes, tags = [], []
    labelled = []
    for text in texts:
        spans = base(text)
        labelled.append((text, spans))
    copies = max(1, min(COPIES, TRAIN_WINDOWS // max(1, sum(len(s) for _, s in labelled))))
    labelled += [rewritten(*one, random) for one in labelled if one[1] for _ in range(copies)]
    for text, spans in labelled:
        chars, label = symbols(text), np.zeros(len(text), np.int64)
        for kind, start, end in spans:
            k = 1 + 2 * KINDS.index(kind)
            label[start:end], label[start] = k + 1, k
        middles = [(s + e) // 2 for _, s, e in spans] + [int(random.integers(0, len(text) + 1))]
        for middle in middles:
            start = max(0, middle - int(random.integers(TRAIN_WINDOW // 4, 3 * TRAIN_WINDOW // 4)))
            code, tag = np.full(TRAIN_WINDOW, SYMBOLS - 1), np.zeros(TRAIN_WINDOW, np.int64)
            part = slice(start, start + TRAIN_WINDOW)
            code[:len(chars[part])], tag[:len(label[part])] = chars[part], label[part]
            tag[0] -= int(tag[0] > 0 and tag[0] % 2 == 0)
            codes.append(code)
            tags.append(tag)
    if not codes:
        return np.zeros((0, TRAIN_WINDOW), np.int64), np.zeros((0, TRAIN_WINDOW), np.int64)
    order = random.permutation(len(codes))[:TRAIN_WINDOWS]
    return np.stack(codes)[order], np.stack(tags)[order]


def train(docs: DataFrame, seed: int = 3) -> Tagger:
    """A tagger from a bounded sample of docs; the sample is all that reaches the driver."""
    usable = docs.filter((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS))
    usable = usable.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    some = (usable.filter(F.col("text").rlike("[0-9@]")).select("h").distinct()
            .orderBy("h").limit(SAMPLE_ROWS))
    # Rows that repeat an id and a text are one, so no more rows come than were picked.
    rows = (usable.join(F.broadcast(some), "h", "left_semi")
            .groupBy("h").agg(F.max("text").alias("text")).collect())
    random = np.random.default_rng(seed)
    texts = [r.text for r in sorted(rows, key=lambda r: (r.h, r.text))]
    return fit(*training_windows(texts, random), seed)


def _stretches(chars: np.ndarray) -> list[tuple[int, int]]:
    """Runs of windows that have a digit or an @, and of their neighbours: first window and the one after the last."""
    last = max(0, -(-(len(chars) - WINDOW) // STRIDE))
    marks = np.flatnonzero((chars == 64) | (chars >= 48) & (chars <= 57))
    live = np.unique(np.concatenate([
        np.minimum(marks // STRIDE, last),
        np.maximum((marks - (WINDOW - STRIDE)) // STRIDE, 0)]))
    live = live[live <= last]
    live = np.unique(np.clip(np.concatenate([live - 1, live, live + 1]), 0, last))
    cuts = np.flatnonzero(np.diff(live) > 1) + 1
    return [(int(run[0]), int(run[-1]) + 1) for run in np.split(live, cuts) if len(run)]


def decode(unary: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best tagging of stretches of equal length, and each position's posterior for its tag."""
    total = moves + _GRID
    count, steps, _ = unary.shape
    best, came = unary[:, 0].copy(), np.zeros((count, steps, TAGS), np.int64)
    best[:, 2::2] -= 1e4
    for t in range(1, steps):
        paths = best[:, :, None] + total
        came[:, t] = paths.argmax(axis=1)
        best = paths.max(axis=1) + unary[:, t]
    tags, rows = np.empty((count, steps), np.int64), np.arange(count)
    tags[:, -1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = came[rows, t, tags[:, t]]
    sure = marginals(unary, moves)[0]
    return tags, np.take_along_axis(sure, tags[:, :, None], axis=2)[:, :, 0]


def _joined(unary: np.ndarray, first: int, after: int, length: int) -> np.ndarray:
    """Scores of a stretch, each position's from the window where it is farthest from an edge.

    Past the end of the text there is nothing but outside.
    """
    edge = (WINDOW - STRIDE) // 2
    parts = [unary[k, 0 if k == first else edge:WINDOW if k == after - 1 else STRIDE + edge]
             for k in range(first, after)]
    own = np.concatenate(parts).astype(np.float64)
    own[length:] = [0.0] + [-1e4] * (TAGS - 1)
    return own


#: Positions that are decoded together.
TOGETHER = 16_384


def tagged(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of the tagger for each text, over the whole of it."""
    codes, places = [], []
    for number, text in enumerate(texts):
        if "@" not in text and not re.search("[0-9]", text):
            continue
        chars = symbols(text)
        for begin, end in _stretches(chars):
            place = (number, begin * STRIDE, min(len(chars), (end - 1) * STRIDE + WINDOW), len(codes))
            for w in range(begin, end):
                code = np.full(WINDOW, SYMBOLS - 1)
                part = chars[w * STRIDE:w * STRIDE + WINDOW]
                code[:len(part)] = part
                codes.append(code)
            places.append((*place, len(codes)))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not codes:
        return out
    unary = np.concatenate([scores(model, np.stack(codes[k:k + 256])) for k in range(0, len(codes), 256)])
    places.sort(key=lambda p: p[4] - p[3])
    while places:
        windows = places[0][4] - places[0][3]
        count = max(1, TOGETHER // (windows * WINDOW))
        some = [p for p in places[:count] if p[4] - p[3] == windows]
        del places[:len(some)]
        own = np.stack([_joined(unary, p[3], p[4], p[2] - p[1]) for p in some])
        for (number, start, *_), tags, sure in zip(some, *decode(own, model.moves)):
            out[number] += _spans(texts[number], start, tags, sure)
    return out


def _spans(text: str, start: int, tags: np.ndarray, sure: np.ndarray):
    """Spans of a tagging that are sure, hold a digit or an @ and do not cut a word."""
    for s in np.flatnonzero(tags % 2 == 1):
        e = s + 1
        while e < len(tags) and tags[e] == tags[s] + 1:
            e += 1
        begin, stop = start + int(s), start + int(e)
        alone = not (text[max(begin - 1, 0):begin].isalnum() or text[stop:stop + 1].isalnum())
        kind = KINDS[(tags[s] - 1) // 2]
        if alone and sure[s:e].mean() >= SURE and plausible(kind, text[begin:stop]):
            yield kind, begin, stop


def plausible(kind: str, span: str) -> bool:
    """Whether a span can be of the kind, however it is written."""
    groups, digits = re.findall("[0-9]+", span), _digits(span)
    if kind == "email":
        return "@" in span
    if kind == "ip":  # four numbers of a byte, with the same marks between them
        marks = set(re.findall("(?<=[0-9])[^0-9]+(?=[0-9])", span))
        return len(groups) == 4 and len(marks) == 1 and all(
            len(x) <= 3 and int(x) <= 255 for x in groups)
    if kind == "card":  # as the pattern reads it, it must pass the pattern's test
        as_read = re.fullmatch("[0-9]([ -]?[0-9])+", span)
        return 14 <= len(digits) <= 19 and (not as_read or _luhn(digits))
    return 10 <= len(digits) <= 15


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, base (pattern spans) and added (spans of the tagger that touch none of them).

    A null text is empty and has no spans; positions are code points, ends exclusive. Repeated rows
    are decided row by row. Without a text that has a digit or an @ there is no training and nothing
    is added. Other columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    model = train(slim)

    def scan(batches):
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            found = [base(t) for t in texts]
            more = [[s for s in spans if all(s[2] <= b[1] or b[2] <= s[1] for b in own)]
                    for spans, own in zip(tagged(model, texts) if model.level.any() else
                                          [[]] * len(texts), found)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans]
                                              for spans in column], _SPANS)
                                    for column in (found, more))], names=["doc_id", "base", "added"])

    return slim.mapInArrow(scan, f"doc_id bigint, base {SPANS}, added {SPANS}")
