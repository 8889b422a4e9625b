"""The queries of this subpackage and the SQL of those that SQL can express."""

from sedimenta.llm.fingerprints import op8_fingerprints
from sedimenta.llm.language_id import op9_language_id
from sedimenta.llm.line_dedup import OP6_SQL, op6_line_dedup
from sedimenta.llm.media import op2_mpeg_audio
from sedimenta.llm.mixing import op1_mixing
from sedimenta.llm.near_dedup import op5_near_dedup
from sedimenta.llm.packing import op7_best_fit_packing
from sedimenta.llm.suffix_tree import op4_suffix_tree
from sedimenta.llm.url_filters import op10_url_filters
from sedimenta.llm.warc import op3_warc

QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_mpeg_audio, op3_warc, op4_suffix_tree, op5_near_dedup, op6_line_dedup, op7_best_fit_packing, op8_fingerprints, op9_language_id, op10_url_filters)
}
SQL = {"op6_line_dedup": OP6_SQL}
