"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

SPACES = re.compile("[\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in SPACES.split(text) if w]


def shingle_set(text):
    w = words(text, True)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def near(rows, percent):
    """doc_id to (set size, smallest id reachable)."""
    sets = {k: shingle_set(t) for k, t in rows}
    reach = {k: k for k in sets}
    holders = {}
    for k, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(k)
    links = set()
    for k, s in sets.items():
        shared = Counter(o for x in s for o in holders[x] if o < k)
        links |= {(k, o) for o, n in shared.items()
                  if 100 * n >= percent * (len(s) + len(sets[o]) - n)}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(reach[a], reach[b])
            changed |= reach[a] != low or reach[b] != low
            reach[a] = reach[b] = low
    return {k: (len(sets[k]), reach[k]) for k in sets}


def listed(spans, kinds):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], kinds.index(x[0]))))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for k, d in enumerate(digits[::-1]):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def private_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def secret_spans(text):
    out = [("assign", *m.span()) for m in re.finditer(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
        r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text)
        if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w = words(text)
    windows = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if windows[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def spellings(rows, least_length=6, least_count=5):
    """(word, form, root, n, n_near, form_n) of every frequent word."""
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def token_rows(rows, encode):
    """(doc_id, start, n_tokens, ids_crc32) in ascending doc_id order; `encode` gives ids of a text."""
    out, start = [], 0
    found = [(key, b"".join(i.to_bytes(4, "little") for i in [*encode(text or ""), 2])) for key, text in rows]
    for key, ids in sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), zlib.crc32(r[1]))):
        out.append((key, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out
