"""Chunks of the driver's documents, held against the rules one by one."""

import re

from quarry.functions import fixed
from quarry.operators import chunking


def paragraphs_by_hand(text):
    """(path, paragraph) line by line."""
    stack, held, out = [], [], []
    for line in [*text.splitlines(), ""]:
        m = re.match(fixed.HEADING, line.strip())
        if m or not line.strip():
            if body := "\n".join(held).strip():
                out.append((" > ".join(stack), body))
            held = []
            if m:
                stack = [*stack[: len(m[1]) - 2], m[2]]
        else:
            held.append(line.rstrip())
    return out


def test_chunks_of_whole_documents(spark, small):
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    marked = [re.sub(r"\n", lambda m, n=[0]: n.__setitem__(0, n[0] + 1) or ("\n\n== Parte ==\n" if n[0] % 5 == 0 else "\n\n" if n[0] % 2 else "\n"), t) for t in docs]
    sizes = chunking.Sizes(most=500, overlap=60, least=40)
    for text in docs + marked:
        chunks, rows = chunking.cut(text, sizes), paragraphs_by_hand(text)
        assert all(0 < len(c) <= sizes.most for _, c in chunks)
        assert [p for p, _ in chunks] == sorted((p for p, _ in chunks), key=[p for p, _ in rows].index)
        for path in dict.fromkeys(p for p, _ in rows):
            mine, bare = [c for p, c in chunks if p == path], lambda s: "".join(s.split())
            told, at = bare("".join(b for p, b in rows if p == path)), 0
            for chunk in mine:  # each goes on where the one before ended, but for the end of that one, which it may repeat
                body = bare(chunk)
                cut = next(k for k in range(sizes.overlap + 1) if told.startswith(body[k:], at) and (k == 0 or told[:at].endswith(body[:k])))
                at += len(body) - cut
            assert at == len(told)
            for a, b in zip(mine, mine[1:]):  # what follows didn't fit any more
                first = b.removeprefix(a[-sizes.overlap :] + "\n\n").split("\n\n")[0]
                assert len(a) + 2 + len(first) > sizes.most


def test_chunk_rows_are_the_cuts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("doc_id AS id", "source", "doc_id AS external_id", "text AS content")
    got = {}
    for r in chunking.chunk_documents(docs).collect():
        got.setdefault(r.document_id, {})[r.ordinal] = (r.section_path, r.content, r.char_count)
    for r in docs.collect():
        assert [got.get(str(r.id), {})[i] for i in sorted(got.get(str(r.id), {}))] == [(p, c, len(c)) for p, c in chunking.cut(r.content)]
