"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from mixtide.llm.digest_index import OP11_SQL, op11_exact_dedup
from mixtide.llm.language import op6_language
from mixtide.llm.maxent import op4_maxent
from mixtide.llm.media import op1_media
from mixtide.llm.mixing import OP2_SQL, op2_mixing
from mixtide.llm.ngram_join import OP3_SQL, op3_ngram_join
from mixtide.llm.packing import op7_packing
from mixtide.llm.quality import op8_quality
from mixtide.llm.runs import op12_runs
from mixtide.llm.secrets import OP5_SQL, op5_secrets
from mixtide.llm.sharding import op9_sharding
from mixtide.llm.spelling import OP13_SQL, op13_spelling
from mixtide.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_media,
        op2_mixing,
        op3_ngram_join,
        op4_maxent,
        op5_secrets,
        op6_language,
        op7_packing,
        op8_quality,
        op9_sharding,
        op10_warc,
        op11_exact_dedup,
        op12_runs,
        op13_spelling,
    )
}
ORACLE = {
    "op2_mixing": OP2_SQL,
    "op3_ngram_join": OP3_SQL,
    "op5_secrets": OP5_SQL,
    "op10_warc": OP10_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op13_spelling": OP13_SQL,
}
