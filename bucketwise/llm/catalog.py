"""Registered queries of the corpus operators and, where SQL can state them, their SQL twins."""

from bucketwise.llm import (
    bpe, chat, decontaminate, exact_dedup, hard_negatives, license_scan, line_dedup, mixing, near_dedup, page_text, quality,
    secret_scan, whitening,
)

QUERIES = {
    f.__name__: f
    for f in (
        exact_dedup.op1_exact_dedup, secret_scan.op2_secret_scan, chat.op3_chat_format, near_dedup.op4_near_dedup,
        page_text.op5_page_text, mixing.op6_mixing, line_dedup.op7_line_dedup,
        quality.op8_quality, decontaminate.op9_decontaminate, license_scan.op10_license_scan,
        hard_negatives.op11_hard_negatives, bpe.op12_bpe, whitening.op13_whitening,
    )
}
SQL = {
    "op1_exact_dedup": exact_dedup.SQL, "op3_chat_format": chat.SQL, "op7_line_dedup": line_dedup.SQL,
    "op10_license_scan": license_scan.SQL, "op11_hard_negatives": hard_negatives.SQL,
}
