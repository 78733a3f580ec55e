"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from shelfmark.llm.decontaminate import op6_greedy_tiling
from shelfmark.llm.interpolation import op1_deleted_interpolation
from shelfmark.llm.language import op7_language_cnn
from shelfmark.llm.licenses import OP5_SQL, op5_license_scan
from shelfmark.llm.mixing import OP9_SQL, op9_mix_sources
from shelfmark.llm.quality import op10_quality_zstd
from shelfmark.llm.quotation import op2_quotation_links
from shelfmark.llm.sharding import op3_shard_ring
from shelfmark.llm.simhash import op8_simhash_gph
from shelfmark.llm.topk import OP4_SQL, op4_topk_tput

QUERIES = {
    f.__name__: f
    for f in (op1_deleted_interpolation, op2_quotation_links, op3_shard_ring, op4_topk_tput, op5_license_scan, op6_greedy_tiling, op7_language_cnn, op8_simhash_gph, op9_mix_sources, op10_quality_zstd)
}
ORACLE_SQL = {"op4_topk_tput": OP4_SQL, "op5_license_scan": OP5_SQL, "op9_mix_sources": OP9_SQL}
