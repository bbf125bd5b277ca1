"""The body of a page: its tag stream cut into blocks, and the connected run of blocks with the most text that isn't links.

A block is what stands between two block-level tags. It counts its words, less LINK for each word
inside a link, less COST, so that menus and lone lines weigh below zero. The body is the run of
blocks with the highest sum; of equal ones that which ends first, and of those the shorter.
Everything is one row's own columns: no parser, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hirelake.functions.names import unescaped

#: What a word in a link takes away, and what a block costs.
LINK, COST = 3, 8
#: Elements without text, and tags that end a block.
MUTE = r"(?is)<(script|style|head|noscript|template|svg)\b.*?</\1\s*>|<!--.*?-->"
BLOCK_TAGS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|tr|ul)\b[^>]*>"

BLOCK = "struct<text:string,words:int,linked:int>"


def _count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def blocks(html: Column) -> Column:
    """Text, words and words in links of each block that has any text."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "[\u0001\u0002\u0003]", " "), MUTE, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<a\b[^>]*>", "\u0001"), r"(?i)</a\s*>", "\u0002")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_TAGS, "\u0003"), r"(?s)<[^>]*>", "")
    text = unescaped(text)

    def block(piece: Column) -> Column:
        links = F.array_join(F.regexp_extract_all(piece, F.lit("\u0001([^\u0001\u0002]*)"), F.lit(1)), " ")
        own = F.trim(F.regexp_replace(F.regexp_replace(piece, "[\u0001\u0002]", ""), r"\s+", " "))
        return F.struct(own.alias("text"), _count(own).alias("words"), _count(links).alias("linked"))

    return F.filter(F.transform(F.split(text, "\u0003"), block), lambda b: b["words"] > 0)


def weight(block: Column, link: int = LINK, cost: int = COST) -> Column:
    return block["words"] - link * block["linked"] - cost


def best_run(weights: Column) -> Column:
    """struct(total, first, last) of the run of weights with the highest sum, from 0; null where none is above zero."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("here"), F.lit(0).alias("since"), F.lit(0).alias("at"))

    def step(s: Column, w: Column) -> Column:
        fresh = s["here"] <= 0
        here = F.when(fresh, w).otherwise(s["here"] + w)
        since = F.when(fresh, s["at"]).otherwise(s["since"])
        better = here > s["total"]
        return F.struct(
            F.when(better, here).otherwise(s["total"]).alias("total"), F.when(better, since).otherwise(s["first"]).alias("first"),
            F.when(better, s["at"]).otherwise(s["last"]).alias("last"), here.alias("here"), since.alias("since"), (s["at"] + 1).alias("at"),
        )

    found = F.aggregate(weights, zero, step)
    return F.when(found["total"] > 0, F.struct(found["total"].alias("total"), found["first"].alias("first"), found["last"].alias("last")))


def body(found: Column, run: Column) -> Column:
    """The texts of a run of blocks, one line each; null without a run."""
    return F.array_join(F.transform(F.slice(found, run["first"] + 1, run["last"] - run["first"] + 1), lambda b: b["text"]), "\n")
