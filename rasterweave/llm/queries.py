"""Queries of the training-data operators, and SQL where it can express them."""

from .conversations import OP11_SQL, op11_conversation_repair
from .dac import op4_token_files
from .decontaminate import OP8_SQL, op8_benchmark_decontamination
from .embeddings import op9_embedding_near_dedup
from .html import op5_html_extraction
from .jaccard import op2_ngram_jaccard
from .language import op1_language_id
from .mixing import op12_source_mixing
from .packing import op10_best_fit_packing
from .quality import op3_quality_classifier
from .urls import OP6_SQL, op6_url_filters
from .warc import OP7_SQL, op7_warc_conversion
from .whitening import op13_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_ngram_jaccard,
        op3_quality_classifier,
        op4_token_files,
        op5_html_extraction,
        op6_url_filters,
        op7_warc_conversion,
        op8_benchmark_decontamination,
        op9_embedding_near_dedup,
        op10_best_fit_packing,
        op11_conversation_repair,
        op12_source_mixing,
        op13_embedding_whitening,
    )
}

ORACLES = {
    "op6_url_filters": OP6_SQL,
    "op7_warc_conversion": OP7_SQL,
    "op8_benchmark_decontamination": OP8_SQL,
    "op11_conversation_repair": OP11_SQL,
}
