"""Queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from lectern.llm import p1_markup as p1
from lectern.llm import p2_sitelines as p2
from lectern.llm import p3_lookalike as p3
from lectern.llm import p4_bitext as p4
from lectern.llm import p5_scan as p5
from lectern.llm import p7_packing as p7
from lectern.llm import p8_leak as p8
from lectern.llm import p9_split as p9


def queries() -> dict:
    return {
        "p1_found": p1.p1_found, "p1_pages": p1.p1_pages, "p1_titles": p1.p1_titles,
        "p2_found": p2.p2_found, "p2_chapters": p2.p2_chapters,
        "p3_found": p3.p3_found, "p3_units": p3.p3_units, "p3_chapters": p3.p3_chapters,
        "p4_found": p4.p4_found, "p4_report": p4.p4_report,
        "p5_found": p5.p5_found, "p5_text": p5.p5_text,
        "p7_bins": p7.p7_bins, "p7_fill": p7.p7_fill,
        "p8_found": p8.p8_found, "p8_items": p8.p8_items,
        "p9_pieces": p9.p9_pieces,
    }


def oracle_sql() -> dict:
    return {"p2_found": p2.P2_SQL}
