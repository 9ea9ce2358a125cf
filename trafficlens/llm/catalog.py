"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    decontaminate, exact_dedup, html_text, language, lexical, line_dedup, mixing, near_dedup, pii, prefix_trie, quality,
    repeats, tokens)
from .common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query("op4_exact_dedup", exact_dedup.SQL)
def op4(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op8_mixing")
def op8(spark, sf_dir):
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


@query("op10_token_output")
def op10(spark, sf_dir):
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


@query("op7_decontamination", decontaminate.SQL)
def op7(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_quality")
def op9(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_personal_data")
def op1(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query("op6_main_text")
def op6(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op2_near_dedup")
def op2(spark, sf_dir):
    return near_dedup.NearDuplicates(table(spark, sf_dir, "documents")).groups()


@query("op5_repeats")
def op5(spark, sf_dir):
    return repeats.Repeats(table(spark, sf_dir, "documents")).report()


@query("op3_line_dedup")
def op3(spark, sf_dir):
    return line_dedup.LineDuplicates(table(spark, sf_dir, "documents"), least=1).report()


@query("op13_prefix_trie", prefix_trie.SQL)
def op13(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op11_ranked_search", lexical.SQL)
def op11(spark, sf_dir):
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_language")
def op12(spark, sf_dir):
    return language.language(table(spark, sf_dir, "documents"))
