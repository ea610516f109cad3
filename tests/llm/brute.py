"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeats(rows, window=13):
    """rows: (doc_id, text). Returns {doc_id: (n_words, n_removed, sha of the kept words)}, a list per id."""
    first: dict = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s:s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        if i is not None:
            for s in range(len(w) - window + 1):
                if first[tuple(w[s:s + window])] < i:
                    gone[s:s + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=repr)


def roots(nodes, pairs):
    """Smallest node reachable, by node."""
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def simhash(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(rows, radius=3):
    prints = {i: simhash(t) for i, t in rows}
    ids = sorted(prints)
    by: dict = {}
    for i in ids:
        by.setdefault(prints[i], []).append(i)
    distinct = sorted(by)
    pairs = [(g[0], x) for g in by.values() for x in g[1:]]
    pairs += [(by[a][0], by[b][0]) for n, a in enumerate(distinct) for b in distinct[n + 1:] if (a ^ b).bit_count() <= radius]
    found = roots(ids, pairs)
    return sorted((i, f"{prints[i]:016x}", found[i]) for i in ids)


def unigram(rows, parts=7, held=2):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) by plain counting."""
    import math
    import zlib
    from collections import Counter

    fold = {i: zlib.crc32(str(i).encode()) % parts if i is not None else -1 for i, _ in rows}
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if fold[i] not in (held, -1) for w in ws)
    n, v = sum(c.values()), len(c)
    return [
        (i, fold[i] == held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        for i, ws in tokens
    ]


def forward(start, move, emit, classes):
    """log likelihood of one sequence; emit is indexed by class, then state."""
    import numpy as np

    a, total = start * emit[classes[0]], 0.0
    for c in classes[1:]:
        s = a.sum()
        total += np.log(s)
        a = (a / s) @ move * emit[c]
    return total + np.log(a.sum())


def alignments(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), text by text with the libraries themselves."""
    from collections import Counter

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    values = {chr(x): x for x in shown} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in shown)}

    def b_bytes(piece):
        return bytes([int(piece[3:5], 16)]) if piece[:3] == "<0x" and len(piece) == 6 else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for i, text in rows:
        groups, links = [], Counter()
        a = [(t, bytes(values[c] for c in a_coder.id_to_token(t))) for t in a_coder.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(t, b_bytes(b_coder.id_to_piece(t))) for t in b_coder.encode(text or "")]
        whole = b" " + (text or "").encode()
        if text and b"".join(x for _, x in a) == whole and b"".join(x for _, x in b) == whole:
            at, left = [0, 0], [list(a), list(b)]
            while left[0]:
                group, at = ([], []), [0, 0]
                while not group[0] or at[0] != at[1]:
                    side = 0 if at[0] <= at[1] else 1
                    token, data = left[side].pop(0)
                    group[side].append(token)
                    at[side] += len(data)
                groups.append(group)
                links.update((x, y) for x in group[0] for y in group[1])
        else:
            a, b = [], []
        counts.update(links.keys())
        digest = sha(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()) if groups else ""
        found.append((i, len(a), len(b), len(groups), links, digest))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    return sorted(
        ((i, a, b, g, sum(ls.values()), sum(k for p, k in ls.items() if counts[p] == best[p[0]]), sum(k * counts[p] for p, k in ls.items()), d)
         for i, a, b, g, ls, d in found), key=repr,
    )


def spelling(rows):
    """(word, n, n_near, form, form_n, root) by looking up every word with one code point left out."""
    import re
    import zlib
    from collections import Counter, defaultdict

    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1:]].add(w)
            if (less := w[:k] + w[k + 1:]) in words:
                near[w].add(less)
                near[less].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, k, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, k in words.items())
