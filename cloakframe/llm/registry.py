"""The queries of this subpackage and their SQL."""

from cloakframe.llm import bpe, chat, jaccard, media, mixing, quality, sharding, suffix, urls, warc

_MODULES = (media, chat, sharding, suffix, warc, mixing, bpe, quality, urls, jaccard)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
