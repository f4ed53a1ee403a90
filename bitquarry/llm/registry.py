"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from bitquarry.llm import elkan, fill_middle, url_filter
from bitquarry.llm.ann import op7_ann
from bitquarry.llm.decontaminate import op8_decontaminate
from bitquarry.llm.elkan import op11_clusters
from bitquarry.llm.fill_middle import op13_fill_middle
from bitquarry.llm.html_text import op2_html_text
from bitquarry.llm.language import op12_language
from bitquarry.llm.licenses import op5_licenses
from bitquarry.llm.line_dedup import op6_line_dedup
from bitquarry.llm.ngram_join import op4_ngram_join
from bitquarry.llm.packing import op9_packing
from bitquarry.llm.token_files import op3_token_files
from bitquarry.llm.toxicity import op1_toxicity
from bitquarry.llm.url_filter import op10_url_filter

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_html_text": op2_html_text,
    "op3_token_files": op3_token_files,
    "op4_ngram_join": op4_ngram_join,
    "op5_licenses": op5_licenses,
    "op6_line_dedup": op6_line_dedup,
    "op7_ann": op7_ann,
    "op8_decontaminate": op8_decontaminate,
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
    "op11_clusters": op11_clusters,
    "op12_language": op12_language,
    "op13_fill_middle": op13_fill_middle,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op10_url_filter": url_filter.ORACLE_SQL,
    "op11_clusters": elkan.ORACLE_SQL,
    "op13_fill_middle": fill_middle.ORACLE_SQL,
}
