import re

from barspark.llm.linededup import deduplicate_lines


def brute(rows):
    big = 1 << 63
    keys = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
            k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
            if len(k) >= 10:
                d = big if i is None else i
                keys.setdefault(k, set()).add(d)
    out = []
    for i, t in rows:
        kept, lines = [], (t or "").split("\n")
        for line in lines:
            k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
            k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
            if k not in keys or (big if i is None else i) == min(keys[k]):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = [(5, "A shared line!\nown line of five\nshort\n"), (3, "  a SHARED line! \t\nshort\na shared line!"), (9, None), (4, ""), (None, "a shared line!\nx"),
            (7, "ééééééééé\nÉÉÉÉÉÉÉÉÉÉ"), (8, "ééééééééé\nÉÉÉÉÉÉÉÉÉÉ"), (8, "ééééééééé\nÉÉÉÉÉÉÉÉÉÉ"), (8, "another text\r\n"), (11, "\x0banother text\x0b\n\n")]
    rows += [(i, f"the common line of all\nline number {i % 40} here\n{'x' * (i % 23)}") for i in range(20, 400)]
    df = spark.createDataFrame([(i, t, "keep", 1) for i, t in rows], "doc_id long, text string, key string, n_lines int")
    got = deduplicate_lines(df)
    assert got.columns == ["doc_id", "text", "key", "dropped_bitmap", "kept_text", "n_lines", "n_dropped"]
    got = got.collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=str) == brute(rows)
    assert all(r.key == "keep" for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert deduplicate_lines(df).count() == 0
