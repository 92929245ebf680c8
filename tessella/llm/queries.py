"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from tessella.llm.chat import OP7_SQL, op7_chat
from tessella.llm.langid import op5_language
from tessella.llm.licenses import op3_licenses
from tessella.llm.mixing import OP6_SQL, op6_mixing
from tessella.llm.neardup import OP10_SQL, op10_minhash
from tessella.llm.packing import op8_packing
from tessella.llm.pagediff import op12_html
from tessella.llm.perplexity import op4_quality
from tessella.llm.phrases import OP11_SQL, op11_phrases
from tessella.llm.sstable import op1_sstable
from tessella.llm.trie import OP13_SQL, op13_prefix_trie
from tessella.llm.warc import OP2_SQL, op2_warc
from tessella.llm.winnowing import op9_winnowing

QUERIES = {
    "op1_sstable": op1_sstable,
    "op2_warc": op2_warc,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_chat": op7_chat,
    "op8_packing": op8_packing,
    "op9_winnowing": op9_winnowing,
    "op10_minhash": op10_minhash,
    "op11_phrases": op11_phrases,
    "op12_html": op12_html,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op6_mixing": OP6_SQL,
    "op7_chat": OP7_SQL,
    "op10_minhash": OP10_SQL,
    "op11_phrases": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
