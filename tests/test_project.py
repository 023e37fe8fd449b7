"""A real project folder, read into catalog tables."""

import json

from conftest import rows
from fleetcat.sources.project import catalog_of_projects, read_project_files


def _write(root, files):
    for path, text in files.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text, encoding="utf-8")


def test_project_folder_to_catalog(spark, tmp_path):
    field = {"Column": {"Expression": {"SourceRef": {"Entity": "Sales"}}, "Property": "Amt"}}
    visual = {"visual": {"visualType": "card", "query": {"queryState": {"Values": {"projections": [{"queryRef": "Sales.Amt", "field": field}]}}}},
              "position": {"x": 1, "y": 2, "width": 3, "height": 4}}
    _write(tmp_path, {
        "Shop A/Shop.pbip": "{}",
        "Shop A/Shop.SemanticModel/definition/tables/Sales.tmdl":
            "table 'Sales Fact'\n\tmeasure Total = ```\n\t\t\tSUM(x)\n\t\t\t```\n\t\tformatString: 0\n\tmeasure Next = 2\n\tcolumn Amt\n\t\tdataType: int64\n"
            "\tpartition p = m\n\t\tmode: import\n\t\tsource = Csv.Document(1)\n",
        "Shop A/Shop.SemanticModel/definition/relationships.tmdl": "relationship r\n\tfromColumn: Sales.k\n\ttoColumn: 'Dim 1'.k\n",
        "Shop A/Shop.SemanticModel/definition/expressions.tmdl": 'expression P = "a" meta [IsParameterQuery=true, Type="Text"]\n',
        "Shop A/Old.Report/report.json": "{}",
        "Shop A/Shop.Report/definition/pages/p1/page.json": '{"displayName":"First"}',
        "Shop A/Shop.Report/definition/pages/p1/visuals/v1/visual.json": json.dumps(visual),
        "Shop A/Shop.Report/definition/pages/p1/visuals/v2/visual.json": "{broken",
        "Shop A/Shop.Report/definition/pages/p2/page.json": '{"displayName":"Empty"}',
        "B/x.Dataset/model.bim": "{}",
        "B/x.Report/report.json": json.dumps({"sections": [{"displayName": "Only", "visualContainers": [{"config": "{}"}]}]}),
        "B/readme.txt": "not a project file",
    })
    c = catalog_of_projects(read_project_files(spark, str(tmp_path)))
    assert rows(c["models"], "project", "status", "model_folder") == [("B", "legacy", "x.Dataset"), ("Shop A", "ok", "Shop.SemanticModel")]
    assert rows(c["reports"], "project", "report_folder", "report_format") == [("B", "x.Report", "classic"), ("Shop A", "Shop.Report", "pages")]
    assert rows(c["measures"], "table_name", "name", "format_string") == [("Sales Fact", "Next", None), ("Sales Fact", "Total", "0")]
    assert rows(c["columns"], "project", "file", "column_name", "data_type") == [("Shop A", "tables/Sales.tmdl", "Amt", "int64")]
    assert rows(c["partitions"], "partition_name", "source_code") == [("p", "Csv.Document(1)")]
    assert rows(c["relationships"], "from_table", "to_table") == [("Sales", "Dim 1")]
    assert rows(c["expressions"], "name", "kind", "default_value", "param_type") == [("P", "parameter", "a", "Text")]
    assert rows(c["pages"], "project", "page", "page_name") == [("B", "1", "Only"), ("Shop A", "p1", "First"), ("Shop A", "p2", "Empty")]
    assert [(r["project"], r["page"], r["visual"], r["type"], r["fields"]) for r in c["visuals"].orderBy("project").collect()] == [
        ("B", "1", "1", "Unknown", []), ("Shop A", "p1", "v1", "card", ["Values: Sales.Amt -> Sales[Amt]"])]
    assert rows(c["quarantined"], "project", "file", "stage") == [("Shop A", "definition/pages/p1/visuals/v2/visual.json", "PARSE")]
