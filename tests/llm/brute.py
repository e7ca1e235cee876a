"""Plain restatements of what the operators compute, for comparison on small inputs."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def sha256(s):
    return hashlib.sha256(s.encode()).hexdigest()


def warc(pages):
    first = {}
    for p, _, h in pages:
        b = (h or "").encode()
        first[b] = min(first.get(b, p), p)
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        to = None if first[b] == p else first[b]
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    return out


def luhn(d):
    s = 0
    for k, c in enumerate(reversed(d)):
        v = int(c) * (1 + k % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def pii(text):
    t = text or ""
    spans = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        spans["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            spans["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            spans["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            spans["phone"].append(m.span())
    base = ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)
    return tuple(len(v) for v in spans.values()), sha256(base), base


def url(u):
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        h = re.match(r"[^/?#]*", rest).group()
        host, path = lower(h), re.match(r"[^?#]*", rest[len(h) :]).group()
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    fit = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[1], best and best[2]


def decontam(docs, bench, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(lower(t or ""))
    own = defaultdict(set)
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            own[tuple(w[k : k + size])].add(str(i))
    lengths = {len(x) for x in own}
    out = []
    for d, t in docs:
        w = words(t)
        hit, items = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in own:
                    hit.update(range(k, k + n))
                    items |= own[x]
        out.append((d, len(w), len(hit), len(items), sha256(",".join(sorted(items))), bool(hit)))
    return out


def quality(text):
    t = text or ""
    w = SPACE_WORD.findall(t)
    lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    cover = set()
    for i, g in enumerate(grams):
        if c[g] > 1:
            cover.update(range(i, i + 5))
    n = len(w)
    return n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover), n < 10 or 100 * len(cover) > 20 * n


def shingles(text):
    w = SPACE_WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def jaccard(docs):
    """All pairs of distinct sets that share a shingle; union-find."""
    sets = [(d, shingles(t)) for d, t in docs]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)

    rep = {}
    for d, s in sets:
        if s:
            join(d, rep.setdefault(s, d))
    names = list(rep)
    post = defaultdict(list)
    for i, s in enumerate(names):
        both = Counter(j for g in s for j in post[g])
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(names[j]) - n):
                join(rep[s], rep[names[j]])
        for g in s:
            post[g].append(i)
    return [(d, len(s), root(d)) for d, s in sets]


def targets(sizes, weights=(5.0, 2.0, 1.0), total=1.0, most=3.0):
    """The target of each source: by weight, the excess over `most` times its size dealt to the others until none is above."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, free = {}, total * sum(sizes.values()), list(order)
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: share * weight[s] for s in free}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def draws(docs, seed=7):
    """docs: (row, source, size, order key). The copies of each row: prefix sums of what is expected, an offset, a copy for
    each integer crossed."""
    sizes = defaultdict(int)
    for _, s, n, _ in docs:
        sizes[s] += n
    goal, out = targets(sizes), {}
    for s in sizes:
        rate = goal[s] / sizes[s] if sizes[s] else 0.0
        at = int(sha256(f"{seed}:{'n' if s is None else 's' + s}")[:12], 16) / 2**48
        for k, (row, *_) in enumerate(sorted((d for d in docs if d[1] == s), key=lambda d: (d[2], d[3]))):
            out[row] = min(3, int((k + 1) * rate + at) - int(k * rate + at))
    return out


def redirects(pages, block="block", allow="allow"):
    """pages: (page_id, url, link or None). The verdict of each page; links resolved by the standard library."""
    from urllib.parse import urljoin

    def node(u):
        if u is None or "://" not in u:
            return None
        rest = u.split("://", 1)[1].split("#")[0]
        path, _, query = rest.partition("?")
        host, _, path = path.partition("/")
        query = "&".join(x for x in query.split("&") if x and not re.match(r"(utm_[a-z]+|fbclid|gclid)=", x))
        return lower(host) + ("/" + path if path else "").removesuffix("/") + ("?" + query if query else "")

    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, u, link in pages:
        if node(u) is not None and link is not None and node(urljoin(u, link)) is not None:
            up[root(node(u))] = root(node(urljoin(u, link)))
    said = defaultdict(set)
    for _, u, _ in pages:
        if (n := node(u)) is not None and (a := url(u)[3]):
            said[root(n)].add(a)
    out = {}
    for p, u, _ in pages:
        n = node(u)
        group = said[root(n)] if n is not None else set()
        out[p] = url(u)[3] or (allow if allow in group or block not in group else block)
    return out


def tokens(docs, path):
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    out, start = [], 0
    for d, t in sorted(docs, key=lambda x: x[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
