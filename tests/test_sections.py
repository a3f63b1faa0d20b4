"""Section split (GEN-1/2): literal expected rows."""
from hypothesis import given, settings, strategies as st

from quarry.operators.sections import split_sections

FULL = "BNS Full Text"
# Text and the (id, title, text) rows it must give.
CASES = [
    ("pre\nSection 303. Theft etc..\nbody\nSection 304A.  Snatch.\nb2\n",
     [("BNS_303", "Theft etc", "Section 303. Theft etc.\n\nbody"),
      ("BNS_304A", "Snatch", "Section 304A. Snatch.\n\nb2")]),
    ("  none here \n", [("BNS_FULL", FULL, "none here")]),
    ("", [("BNS_FULL", FULL, "")]),
    ("Section 5.\n\nSection 6. X\nbody", [("BNS_5", "Section 6. X", "Section 5. Section 6. X.\n\nbody")]),
    ("  Section 9. indented\n", [("BNS_FULL", FULL, "Section 9. indented")]),
    ("Section 7. Ti\u2028tle\u0085x\nbody", [("BNS_7", "Ti\u2028tle\u0085x", "Section 7. Ti\u2028tle\u0085x.\n\nbody")]),
    ("Section\u00a012. No-break space\nbody", [("BNS_12", "No-break space", "Section 12. No-break space.\n\nbody")]),
    ("Section \u096b. Devanagari digit\nbody", [("BNS_\u096b", "Devanagari digit",
                                               "Section \u096b. Devanagari digit.\n\nbody")]),
    ("Section 1. A\r\nbody\r\nSection 2. B\r\n", [("BNS_1", "A", "Section 1. A.\n\nbody"),
                                                 ("BNS_2", "B", "Section 2. B.\n\n")]),
    ("Section 3. Title\n", [("BNS_3", "Title", "Section 3. Title.\n\n")]),
    ("Section 4. T. . .\nx\nSection 4. dup\ny", [("BNS_4", "T. . ", "Section 4. T. . .\n\nx"),
                                              ("BNS_4", "dup", "Section 4. dup.\n\ny")]),
    ("Section 303. Theft.\nAny theft of goods is paid for with nine coins.\nSection 318. Cheating.\nA false weight is broken.\n",
     [("BNS_303", "Theft", "Section 303. Theft.\n\nAny theft of goods is paid for with nine coins."),
      ("BNS_318", "Cheating", "Section 318. Cheating.\n\nA false weight is broken.")]),
]


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = split_sections(df).orderBy("doc_id", "section_ord").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.section_id, r.title, r.text))
    return got


def test_fixture_cases(spark):
    got = run(spark, [t for t, _ in CASES])
    for i, (text, rows) in enumerate(CASES):
        assert got[i] == rows, (i, text)


# Clean titles and bodies, so that the rows are known from the parts.
_title = st.text(alphabet="abcXYZ ,", min_size=1, max_size=12).map(str.strip).filter(bool)
_body = st.lists(st.text(alphabet="abcxyz", min_size=1, max_size=8), max_size=4).map("\n".join)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 999), _title, _body), min_size=1, max_size=5), st.text("ab \n", max_size=8))
def test_parts_come_back(spark, parts, pre):
    text = pre + "".join(f"\nSection {n}. {t}.\n{b}\n" for n, t, b in parts)
    assert run(spark, [text])[0] == [(f"BNS_{n}", t, f"Section {n}. {t}.\n\n{b}") for n, t, b in parts]
