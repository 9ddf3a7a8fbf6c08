"""Queries of the operators on pages, embeddings and conversations."""

from __future__ import annotations

from portolan.llm import prefix_trie, url_filter, whitening
from portolan.llm.common import read
from portolan.llm.queries import query


@query("op11_prefix_trie", prefix_trie.sql())
def prefix_trie_query(spark, d):
    return prefix_trie.nodes(prefix_trie.rebuilt(read(spark, d, "conversations")))


@query("op12_whitening")
def whitening_query(spark, d):
    return whitening.whitened(read(spark, d, "embeddings"))


@query("op13_url_filter")
def url_filter_query(spark, d):
    return url_filter.judge(read(spark, d, "pages"))
