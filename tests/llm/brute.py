"""Plain Python versions of the operators, for small inputs; they take nothing from the modules they check."""

import hashlib
import math
import re
import zlib
from collections import Counter

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"
# The contract's patterns of strong parts, and the forms of weak ones as the README tells them.
STRONG = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
}
NAMES = "user|username|user_name|userid|user_id|login|account|accountname|account_name|accountid|account_id|clientid|client_id|accesskeyid|access_keyid|accesskey_id|access_key_id"
KINDS = ["assign", "access", "hex", "ident", "key", "endpoint"]
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "key": "secret", "endpoint": "endpoint"}
REACH = 200


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def _weak(text):
    """Weak parts, by plain rules."""
    for m in re.finditer(rf"""(?i:({NAMES}))["']? *[:=] *["']?([A-Za-z0-9_.@-]+)""", text, re.ASCII):
        if m.start() and re.match("[A-Za-z0-9]", text[m.start() - 1]):
            continue
        if len(m[2]) >= 3:
            yield "ident", m.start(), m.end()
    for m in re.finditer(r"(?i:http|https|s3|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", text, re.ASCII):
        if len(m[0]) >= 10:
            yield "endpoint", m.start(), m.end()
    at = 0
    while at < len(text):
        end = next((e for chars in (URL_CHARS, BASE64_CHARS) if (e := _key_end(text, at, chars))), None)
        if end:
            yield "key", at, end
        at = end or at + 1


LOWER, UPPER, DIGITS = set("abcdefghijklmnopqrstuvwxyz"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), set("0123456789")
BASE64_CHARS, URL_CHARS = LOWER | UPPER | DIGITS | set("/+"), LOWER | UPPER | DIGITS | set("_-")


def _key_end(text, at, chars):
    """The end of a key that starts here: a whole run of 32 signs or more with its padding."""
    around = BASE64_CHARS | (chars & set("_-"))
    if text[at] not in chars or at and text[at - 1] in around:
        return None
    end = at
    while end < len(text) and text[end] in chars:
        end += 1
    run = set(text[at:end])
    if end - at < 32 or not run & DIGITS or not (run & LOWER and run & UPPER if chars is URL_CHARS else run - DIGITS - set("abcdef")):
        return None
    stop = end
    while text[stop : stop + 1] == "=":
        stop += 1
    return None if stop - end > 2 or text[stop : stop + 1] in around and stop < len(text) else stop


def secret_spans(text, reach=REACH):
    """(start, rank, kind, end) of all reported parts."""
    text, found = text or "", []
    for kind, (pattern, group, least) in STRONG.items():
        found += [(m.start(), KINDS.index(kind), kind, m.end()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    found += [(a, KINDS.index(kind), kind, b) for kind, a, b in _weak(text)]
    out = []
    for a, r, kind, b in found:
        near = {ROLES[k] for c, _, k, d in found if max(c - b, a - d) <= reach and ROLES[k] != ROLES[kind]}
        if kind in STRONG or {"identifier", "secret"} - {ROLES[kind]} <= near:
            out.append((a, r, kind, b))
    return sorted(out)


def secret_row(text):
    spans = secret_spans(text)
    say = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, k, b in xs)
    base = [x for x in spans if x[2] in STRONG]
    return tuple(sum(x[2] == k for x in base) for k in STRONG) + (sha(say(base)), say(spans))


def words(text):
    return [w for w in re.split(f"[{BLANK}]+", text or "") if w]


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))


def language_model(rows):
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (id, text) rows: pairs with discounts from counts of
    counts, over a base of single words."""
    texts = [["start", *words((t or "").translate(LETTERS)), "\n"] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    count, pairs, context = Counter(), Counter(), Counter()
    for ws, h in zip(texts, held, strict=True):
        if not h:
            count.update(ws[1:])
            pairs.update(zip([None, *ws[1:-1]], ws[1:], strict=True))
            context.update([None, *ws[1:-1]])
    n, kinds, of = sum(count.values()), len(count), Counter(pairs.values())
    cut = [0.5] * 3
    if of[1] and of[2]:
        y = of[1] / (of[1] + 2 * of[2])
        cut = [1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3] if of[3] else 1.5]
        cut = [min(max(d, 0.1), k + 0.9) for k, d in enumerate(cut)]
    left = Counter()
    for (a, _), k in pairs.items():
        left[a] += cut[min(k, 3) - 1]
    out = []
    for (i, _), ws, h in zip(rows, texts, held, strict=True):
        base = score = 0.0
        for a, w in zip([None, *ws[1:-1]], ws[1:], strict=True):
            p = (count[w] + 0.1) / (n + 0.1 * (kinds + 1))
            base += math.log10(p)
            if context[a]:
                k = pairs[a, w]
                p = (k - cut[min(k, 3) - 1] if k else 0) / context[a] + left[a] / context[a] * p
            score += math.log10(p)
        out.append((i, h, len(ws) - 1, sum(count[w] > 0 for w in ws[1:]), n, base, score))
    return out


def distance(a, b):
    """Edits between two words; a swap of two letters that stand together is one."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]
