"""The queries of this subpackage and their SQL."""

from . import html_text, jpeg_media, language_id, licences, mixing, near_dup, quality, sentencepiece_codec, token_counts, warc

QUERIES = {
    f.__name__: f
    for f in (
        sentencepiece_codec.op1_sentencepiece,
        warc.op2_warc,
        jpeg_media.op3_media,
        token_counts.op4_token_counts,
        html_text.op5_html,
        licences.op6_licences,
        language_id.op7_language,
        quality.op8_quality,
        near_dup.op9_near_dup,
        mixing.op10_mixing,
    )
}

ORACLES = {"op2_warc": warc.OP2_SQL, "op10_mixing": mixing.OP10_SQL}
