"""Named queries of the operators of this folder; the parameters are those of production."""

from __future__ import annotations

from corpusloom.llm import bpe, lookalikes, maincontent, mixing, pieces, reading, survivors
from corpusloom.runtime import table

TEXTS = ["markdown", "plain_text"]


def p1_found(spark, folder):
    return pieces.oversized(table(spark, folder, "clean_content"), "content_id", TEXTS)


def p1_pieces(spark, folder):
    return pieces.split_oversized(table(spark, folder, "clean_content"), "content_id", TEXTS)


def _pages(spark, folder):
    return maincontent.page_table(table(spark, folder, "raw_tabs"), table(spark, folder, "raw_tab_details"))


def p3_found(spark, folder):
    return maincontent.main_content(_pages(spark, folder), texts=False)


def p3_text(spark, folder):
    return maincontent.main_content(_pages(spark, folder))


def p4_found(spark, folder):
    values = lookalikes.text_values(table(spark, folder, "disease_documents"), table(spark, folder, "search_candidates"))
    return lookalikes.lookalike_pairs(values)


def p4_forms(spark, folder):
    values = lookalikes.text_values(table(spark, folder, "disease_documents"), table(spark, folder, "search_candidates"))
    return lookalikes.consistent_form(values, "value")


def p5_found(spark, folder):
    return survivors.survivor_sources(table(spark, folder, "report_items"), doubts=survivors.report_doubts())


def p5_records(spark, folder):
    return survivors.survivor_records(table(spark, folder, "report_items"), doubts=survivors.report_doubts())


def p5_layers(spark, folder):
    return survivors.survivor_records(table(spark, folder, "report_items"), doubts=survivors.report_doubts(), policy="layers")


def p6_ids(spark, folder):
    return bpe.token_ids(table(spark, folder, "documents"))


def _mix(spark, folder):
    return [table(spark, folder, x) for x in ("documents", "mix_plans", "mix_targets")]


def p7_mix(spark, folder):
    return mixing.mixed(*_mix(spark, folder))


def p7_shares(spark, folder):
    return mixing.share_report(*_mix(spark, folder))


def p7_temperature(spark, folder):
    return mixing.temperature_report(table(spark, folder, "documents"), size_ratio=0.5, max_repeats=4)


def p8_found(spark, folder):
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


def p8_profile(spark, folder):
    return reading.level_profile(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


def queries():
    return {
        f.__name__: f
        for f in (
            p1_found, p1_pieces, p3_found, p3_text, p4_found, p4_forms, p5_found, p5_records, p5_layers,
            p6_ids, p7_mix, p7_shares, p7_temperature, p8_found, p8_profile,
        )
    }


def oracle_sql():
    from corpusloom.llm import oracle

    return oracle.SQL
