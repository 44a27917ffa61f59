import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import fixed
from quarry.operators import corpus
from quarry.sources import parsers, policy


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


def test_tables_become_sentences():
    assert parsers.parse("a.csv", b"nome;valor\nAlfa;1\n;\nBeta;")[0] == "nome: Alfa; valor: 1\nnome: Beta"
    assert parsers.parse("a.tsv", b"x\t\n1\t2")[0] == "x: 1; coluna 2: 2"
    assert parsers.parse("a.csv", b"a,b")[0] == ""
    assert parsers.rows_to_sentences([["a"], ["1", "beyond"], [None]]) == ["a: 1"]


def test_docx_headings_and_tables():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Titulo</w:t></w:r></w:p><w:p><w:r><w:t>Texto</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    text = parsers.parse("x.docx", zipped(**{"word__document.xml": body}))[0]
    assert "=== Titulo ===" in text and text.endswith("Texto\n\na | b")


def test_sheet_sections():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Dados" r:id="r1"/></sheets></workbook>'
    sheet = f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>c</t></is></c></row><row><c r="A2"><v>5</v></c><c r="C2"><v>6</v></c></row></sheetData></worksheet>'
    shared = f"<sst {s}><si><t>a</t></si></sst>"
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>'
    text = parsers.parse("x.xlsx", zipped(**{"xl__workbook.xml": book, "xl__worksheets__s.xml": sheet, "xl__sharedStrings.xml": shared, "xl___rels__workbook.xml.rels": rels}))[0]
    assert text == "\n== Dados ==\n\na: 5; c: 6"


def test_unknown_and_broken_files_are_rows(spark):
    files = spark.createDataFrame([("a.xyz", b"1"), ("b.docx", b"no zip"), ("c.txt", "olá".encode()), ("d.txt", b" ")], "path string, content binary")
    got = {r.path: r for r in parsers.parse_files(files).collect()}
    assert "nao suportada" in got["a.xyz"].error and "BadZipFile" in got["b.docx"].error and got["c.txt"].text == "olá" and got["d.txt"].error


def test_paths_stay_below_the_root(tmp_path, spark):
    root, outside = tmp_path / "root", tmp_path / "secret.txt"
    root.mkdir()
    outside.write_text("x")
    (root / "a.txt").write_text("texto")
    (root / "link.txt").symlink_to(outside)
    p = policy.Policy(str(root))
    assert policy.load(spark, p, "a.txt").first().title == "a"
    for bad in ("../secret.txt", str(outside), "link.txt", "missing.txt", "", "a.exe"):
        with pytest.raises(policy.Rejected):
            p.check(bad)
    with pytest.raises(policy.Rejected):
        policy.Policy().check("a.txt")
    assert [r.too_big for r in policy.available(spark, policy.Policy(str(root), most_bytes=1)).collect()][0]


def test_hosts_and_redirects():
    p = policy.Policy(hosts=("pt.wikipedia.org",), most_bytes=10)
    assert p.host_ok("https://pt.wikipedia.org/x") and not p.host_ok("https://pt.wikipedia.org.evil.com/") and not p.host_ok("http://169.254.169.254/")
    assert policy.fetch(p, "https://pt.wikipedia.org/x", lambda u: (u, [b"abc"])) == "abc"
    for opener in (lambda u: ("http://evil.com/", [b"x"]), lambda u: (u, [b"x" * 11])):
        with pytest.raises(policy.Rejected):
            policy.fetch(p, "https://pt.wikipedia.org/x", opener)
    with pytest.raises(policy.Rejected):
        p.check_url("file:///etc/passwd")


def test_folder_titles_from_siblings(tmp_path, spark):
    (tmp_path / "doc.csv").write_text("a,b\n1,2")
    (tmp_path / "doc.txt").write_text("Empresa X\n\nAssunto Y\nresto")
    (tmp_path / "solo.txt").write_text("corpo")
    got = {r.title: r.content for r in policy.read_directory(spark, tmp_path.as_uri()).collect()}
    assert got == {"Empresa X - Assunto Y": "a: 1; b: 2", "solo": "corpo"}


def test_pdf_signature(spark):
    df = spark.createDataFrame([(b"%PDF-1.4",), (b"<html>",)], "c binary")
    assert [r[0] for r in df.select(policy.is_pdf(F.col("c"))).collect()] == [True, False]


def test_filings(spark, tmp_path):
    path = tmp_path / "f.csv"
    head = ";".join(fixed.FILING_COLUMNS)
    rows = ["Alfa Mineracao S.A.;Aquisição da Betanorte;Fato Relevante;2024;p1;u", "Betanorte SA;Venda de ativo;Fato Relevante;2024;p2;u", "Betanorte SA;Acordo com Alfa Mineracao;Comunicado ao Mercado;2024;p3;u", "Gama;Aquisição da Betanorte;Outros;2024;p4;u"]
    path.write_text("\n".join([head, *rows]), encoding="latin-1")
    facts = corpus.facts(corpus.filings(policy.filings_csv(spark, str(path))))
    assert {(r.citing, r.cited) for r in corpus.citation_pairs(facts).collect()} == {("Alfa Mineracao S.A.", "Betanorte SA"), ("Betanorte SA", "Alfa Mineracao S.A.")}
    chosen, pairs = corpus.select_documents(facts, per_company=1)
    assert [r["protocol"] for r in chosen] == ["p1", "p2"] and len(pairs) == 2
    assert [r.protocol for r in corpus.by_manifest(facts, ["p3", "zz", "p1"]).collect()] == ["p3", "p1"]
