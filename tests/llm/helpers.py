"""Small documents that hold the odd cases, and plain versions of shared notions."""

from __future__ import annotations

import re
import zlib

SF = "/root/testdata/sf0.001"
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id string, piece_ids string, label_id int, id int"


def odd_rows():
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog while the cat sleeps in the warm sun all day"
    texts = [
        (1, base), (2, base), (2, base), (3, base + " today"), (4, None), (5, ""), (6, "   \n\t "), (None, base), (None, None),
        (7, long_text), (8, long_text + " end"), (9, "one two"), (10, "one two"), (11, "ONE two"), (12, "x" * 50_000),
        (13, "Released under the MIT License.\nAll rights reserved."), (14, "licensed under CC BY-NC 4.0 and cc by nc"), (15, "▁ \x00 é 漢字 🎉\r\n"), (16, "<s> </s> <|endoftext|>"),
        (1 << 40, "a far id"), (-3, "a negative id"),
    ]
    return [(i, t, None, None if k % 2 else "src", None, 0.5, "clash", "clash", k, k) for k, (i, t) in enumerate(texts)]


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA)


def lower(text: str | None) -> str:
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def blank_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def plain_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingles(words: list[str], size: int = 5) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else ([tuple(words)] if words else [])


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
