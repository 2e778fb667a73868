"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from procflow.llm import ann, chat_format, decontaminate, html_extract, license_scan, merkle, mixing, quality_rules, secret_scan, sharding, simhash, toxicity, whitening


def queries():
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_sharding": sharding.op4_sharding,
        "op5_simhash": simhash.op5_simhash,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_chat_format": chat_format.op8_chat_format,
        "op9_html_extract": html_extract.op9_html_extract,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_whitening": whitening.op11_whitening,
        "op12_merkle": merkle.op12_merkle,
        "op13_nearest": ann.op13_nearest,
    }


def oracle_sql():
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op8_chat_format": chat_format.OP8_SQL,
        "op12_merkle": merkle.OP12_SQL,
    }
