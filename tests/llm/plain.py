"""Brute-force versions of the operators' contracts, in plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_counts(text):
    words = BLANK_WORDS.findall(text or "")
    lines = [x for x in (text or "").split("\n") if BLANK_WORDS.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    repeated = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated),
            n < 10 or 100 * len(repeated) > 20 * n)


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(text):
    total = 0
    for k, c in enumerate(reversed(digits(text))):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text, kinds):
    """kind:start:end by start, then kind as listed."""
    found = [(m.start(), rank, m.end(), kind) for rank, (kind, (pattern, check)) in enumerate(kinds.items()) for m in re.finditer(pattern, text or "") if check(m)]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m[0])) <= 19 and luhn(m[0])),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m[0])) <= 15),
}
SECRET = {
    "assign": (r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def contamination(texts, items):
    windows, sizes = collections.defaultdict(set), set()
    for item, text in items:
        words = PLAIN_WORDS.findall((text or "").translate(LOWER))
        if words:
            size = min(10, len(words))
            sizes.add(size)
            for k in range(len(words) - size + 1):
                windows[tuple(words[k:k + size])].add(item)
    out = []
    for doc, text in texts:
        words, hit, found = PLAIN_WORDS.findall((text or "").translate(LOWER)), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if (at := windows.get(tuple(words[k:k + size]))):
                    hit.update(range(k, k + size))
                    found |= at
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def components(texts, size, similarity=80):
    """(doc_id, set size, smallest reachable id) by comparing all pairs."""
    sets = []
    for _, text in texts:
        words = BLANK_WORDS.findall((text or "").translate(LOWER))
        sets.append({tuple(words[k:k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(texts):
        known = [x for x in (smallest.get(find(i)), doc) if x is not None]
        smallest[find(i)] = min(known) if known else None
    return [(doc, len(sets[i]), smallest[find(i)]) for i, (doc, _) in enumerate(texts)]


def token_rows(texts, tokenizer):
    """(doc_id, start, n_tokens, crc) in ascending order of id."""
    start, out = 0, []
    for doc, text in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def trie(rows):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every prefix."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    members = collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append((c, d == len(built)))
    children, total = collections.Counter(p[:-1] for p in members if p), collections.defaultdict(lambda: [0, 0])
    for p, convs in members.items():
        for d in range(len(p) + 1):
            total[p[:d]][0] += p not in children
            total[p[:d]][1] += (len(convs) - 1) * len(p[-1][1].encode()) if p else 0
    least = {p: min(c for c, _ in convs) for p, convs in members.items()}
    return [(least[p], len(p), least[p[:-1]] if p else None, len(convs), children[p], *total[p],
             hashlib.sha256(",".join(str(c) for c in sorted(c for c, end in convs if end)).encode()).hexdigest()) for p, convs in members.items()]


def grid_vectors(rows, length):
    """(vec_id, integer coordinates) of the usable vectors of one length."""
    return [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == length and all(c is not None and math.isfinite(c) for c in v)]


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    found = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return found[1].translate(LOWER), found[2]


def rule_of(host, path, rules):
    """(rule, verdict) of the longest rule that fits."""
    fits = [(len(h + p), len(h), h + p, verdict) for h, p, verdict in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def url_slots(host, path, slots):
    found = set()
    for kind, text in (("host", host), ("path", path)):
        marked = "^" + re.sub("[1-9]", "0", text) + "$"
        for n in (3, 4):
            for k in range(len(marked) - n + 1):
                h = 42
                for part in (kind, *marked[k:k + n]):
                    h = xxhash.xxh64_intdigest(part.encode(), seed=h)
                found.add(h % slots)
    return found


def url_score(host, path, weights):
    at = url_slots(host, path, len(weights) - 1)
    return 1 / (1 + math.exp(-(weights[-1] + (sum(weights[k] for k in at) / math.sqrt(len(at)) if at else 0))))


def cnn_score(net, text, width, half):
    """Forward pass of the byte network over one text, place by place."""
    data = list((text or "").encode())
    if not data:
        return 1 / (1 + math.exp(-float(net.shift[0])))
    k = len(net.bias)
    answer = []
    for p in range(len(data)):
        window = [data[p + w] if p + w < len(data) else 256 for w in range(width)]
        answer.append([sum(float(net.taps[w][c][f]) for w, c in enumerate(window)) for f in range(k)])
    halves = [[max(a[f] for a in answer[lo:lo + half]) for f in range(k)] for lo in range(0, len(answer), half)]
    chunks = [[max(x) for x in zip(a, b)] for a, b in zip(halves, halves[1:])] or halves
    values = [[math.tanh(v + float(net.bias[f])) for f, v in enumerate(c)] for c in chunks]
    row = [g(c[f] for c in values) for g in (max, lambda x: sum(x) / len(values), min) for f in range(k)]
    return 1 / (1 + math.exp(-(sum(r * float(w) for r, w in zip(row, net.weights)) + float(net.shift[0]))))


def _mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def byte_grams(text, size):
    """Runs of bytes of the folded text between two spaces, none with two spaces side by side."""
    folded = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    padded = b" " + folded + b" "
    runs = [padded[k:k + size] for k in range(len(padded) - size + 1)]
    return [r for r in runs if r[:2] != b"  " and r[-2:] != b"  "]


def language_counts(filter_, text, sizes, table_bits, places):
    """Corrected counts by language, testing every n-gram in every language's plane by itself."""
    out = []
    grams = [(size, g) for size in sizes for g in byte_grams(text, size)]
    for n in range(len(filter_.languages)):
        plane, bit, hits = filter_.masks[n // 64], n % 64, 0
        for size, gram in grams:
            key = size
            for b in gram:
                key = (key << 8 | b) & (1 << 64) - 1
            spots = [_mixed(key ^ ((k + 1) << 56)) >> 64 - table_bits for k in range(places)]
            hits += all(int(plane[at]) >> bit & 1 for at in spots)
        chance = float(filter_.chance[n])
        out.append(max(hits - len(grams) * chance, 0) / (1 - chance))
    return out


def chain_scores(chain, found, counts):
    """Forward pass of the classifier chain. found: how often each kept term occurs; counts: words of the text."""
    values = [float(f > 0) for f in found] + [math.log1p(100 * f / max(counts, 20)) for f in found]
    out = []
    for w in chain.weights:
        earlier = [math.log(p / (1 - p)) for p in (min(max(q, 1e-4), 1 - 1e-4) for q in out)]
        z = sum(v * float(x) for v, x in zip([*values, *earlier], w[:-1])) + float(w[-1])
        out.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
    return out


def raked(cells, targets, rounds=400):
    """cells: tokens by (value, value, ...); targets: share by value, one dict per dimension. Weights after many rounds."""
    weight = {c: float(t) for c, t in cells.items() if t > 0}
    for _ in range(rounds):
        for d, target in enumerate(targets):
            sums = collections.Counter()
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {c: w * target[c[d]] / sums[c[d]] for c, w in weight.items()}
    return weight
