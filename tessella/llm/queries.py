"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import bpe, divergence, fingerprints, media, minhash, mixing, pii, quality, resampling, secrets, tokens, urls, warc

QUERIES = {
    "op1_minhash": minhash.op1_minhash,
    "op2_media": media.op2_media,
    "op3_pii": pii.op3_pii,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_url_filter": urls.op5_url_filter,
    "op6_warc": warc.op6_warc,
    "op7_quality": quality.op7_quality,
    "op8_bpe": bpe.op8_bpe,
    "op9_mixing": mixing.op9_mixing,
    "op10_secrets": secrets.op10_secrets,
    "op11_resampling": resampling.op11_resampling,
    "op12_divergence": divergence.op12_divergence,
    "op13_token_counts": tokens.op13_token_counts,
}

ORACLE_SQL: dict[str, str] = {"op5_url_filter": urls.SQL, "op11_resampling": resampling.SQL, "op12_divergence": divergence.SQL}
