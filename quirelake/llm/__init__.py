"""Operations of a training-data pipeline over document tables.

Nothing outside this folder imports it; ``QUERIES`` and ``ORACLES`` are what
the entry module registers."""

from . import embedding_dedup, exact_dedup, language_id, mixing, order_minhash, packing, quality, sweep, syncmers, token_alignment, token_counts, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        embedding_dedup.op1_embedding_dedup,
        mixing.op2_mixing,
        warc.op3_warc,
        exact_dedup.op4_exact_dedup,
        quality.op5_quality,
        packing.op6_packing,
        order_minhash.op7_order_minhash,
        language_id.op8_language_id,
        toxicity.op9_toxicity,
        token_counts.op10_token_counts,
        token_alignment.op11_token_alignment,
        syncmers.op12_syncmers,
        sweep.op13_open_sales,
    )
}
ORACLES = {
    "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op3_warc": warc.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op13_open_sales": sweep.ORACLE_SQL,
}
