"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from loomscope.llm import broken_pairs, cross_split, mixing, near_duplicates, packing, stuffed_pages, target_sample

QUERIES = {
    "p1_found": near_duplicates.p1_found,
    "p2_found": broken_pairs.p2_found,
    "p2_by_defect": broken_pairs.p2_by_defect,
    "p3_found": cross_split.p3_found,
    "p3_report": cross_split.p3_report,
    "p4_found": target_sample.p4_found,
    "p4_plan": target_sample.p4_plan,
    "p4_sample": target_sample.p4_sample,
    "p5_packed": packing.p5_packed,
    "p5_fill": packing.p5_fill,
    "p5_waste": packing.p5_waste,
    "p6_mix": mixing.p6_mix,
    "p6_shares": mixing.p6_shares,
    "p7_found": stuffed_pages.p7_found,
    "p7_by_language": stuffed_pages.p7_by_language,
}

ORACLES: dict[str, str] = {
    "p4_found": target_sample.P4_FOUND_SQL,
}
