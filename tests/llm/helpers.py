"""Small tables and brute-force versions for the tests of this folder."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import xxhash

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix potions for a boxing match in the old town".split()


def doc_rows(texts):
    """Rows of documents with ids 0, 1, ... for the texts."""
    return [(k, t, "en", f"src{k % 3}", len(t) if t is not None else None) for k, t in enumerate(texts)]


def documents(spark, rows, parts=3):
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(parts) if rows else spark.createDataFrame([], DOC_SCHEMA)


def odd_texts():
    """Null, empty, blank, repeated, very long, and texts beyond ASCII."""
    return [None, "", " \t\n ", "a", "a", "A  b\n c", "A b c", " ".join(PROSE * 3), " ".join(PROSE * 3).replace(" ", "\t"), "x" * 5000,
            "word " * 4000, "Größe und Straße für élève niño", "漢字 かな 😀 <|endoftext|> 　\xa0 end", "line one\n\nline  two\r\n", "\x00\x1c mixed \x7f"]


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def exact_groups(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[normalised(row[1])].append(row[0])
    return {key: (min(ids), len(ids), hashlib.sha256(key.encode()).hexdigest()) for key, ids in groups.items()}


def simhash(text):
    lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    found = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def linked(prints, radius=2):
    """Smallest id that each id reaches over fingerprints at most ``radius`` bits apart."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in ids}


def contract_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(text, items):
    """(n_words, n_hit, n_items, items_sha256, contaminated) by looking at every window of every item."""
    words, hit, names = contract_words(text), set(), set()
    for name, body in items:
        phrase = contract_words(body)
        size = min(13, len(phrase))
        windows = {tuple(phrase[k : k + size]) for k in range(len(phrase) - size + 1)} if size else set()
        for k in range(len(words) - size + 1 if size else 0):
            if tuple(words[k : k + size]) in windows:
                hit.update(range(k, k + size))
                names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)


def without_repeats(rows, window=100):
    """Per row, in order: (bytes, removed, spans, sha256 of what is kept)."""
    seen, out = set(), []
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        raw = (row[1] or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if raw[k : k + window] in seen:
                gone[k : k + window] = b"\1" * window
            seen.add(raw[k : k + window])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((row[0], len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def crc(ids):
    return zlib.crc32(packed(ids))


def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]
