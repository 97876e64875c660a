"""Workbooks give every sheet's rows: shared and inline strings, numbers, dates and formula results."""

import io
import zipfile

from postrider.sources.extract import extract_one

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def test_rows_of_all_sheets():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>red</t></si><si><r><t>bl</t></r><r><t>ue</t></r></si></sst>")
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET.format('<row><c t="s"><v>1</v></c><c><v>42.5</v></c></row><row/><row><c t="s"><v>0</v></c><c s="1"><v>45292</v></c></row>'))
        z.writestr("xl/worksheets/sheet2.xml", SHEET.format('<row><c t="inlineStr"><is><t>inline</t></is></c><c t="str"><f>A1</f><v>made</v></c><c t="b"><v>1</v></c></row><row><c t="s"><v>1</v></c></row>'))
    assert extract_one(out.getvalue(), None, "a.xlsx") == ("extracted", "blue 42.5\nred 2024-01-01 00:00:00\ninline made True\nblue")
