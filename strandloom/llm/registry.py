"""The queries of this subpackage and their SQL."""

from strandloom.llm import bpe, decontaminate, html, langid, licenses, linededup, minhash, toxicity, vectors

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_token_counts": bpe.op4_token_counts,
    "op5_bpe_encode_decode": bpe.op5_bpe_encode_decode,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_language_id": langid.op8_language_id,
    "op9_html_extraction": html.op9_html_extraction,
    "op10_embedding_near_dedup": vectors.op10_embedding_near_dedup,
}

SQL = {
    "op1_minhash_near_dedup": minhash.OP1_SQL,
    "op7_benchmark_decontamination": decontaminate.OP7_SQL,
    "op10_embedding_near_dedup": vectors.OP10_SQL,
}
