"""A small application export as a graph."""

from quarrygraph.sources import application

FILES = [
    ("f1/application/create_application.sql", "begin\nwwv_flow_imp.component_begin(p_default_application_id=>100,p_default_owner=>'SHOP');\nwwv_flow_imp.create_flow(\n p_id=>100\n,p_name=>'Shop');\nwwv_flow_imp_shared.create_security_scheme(p_id=>wwv_flow_imp.id(5),p_name=>'Admins',p_scheme_type=>'NATIVE_EXISTS',p_attribute_01=>'select 1 from roles');\nend;\n/"),
    ("f1/application/pages/page_00010.sql", """begin
wwv_flow_imp.component_begin(p_default_application_id=>100);
wwv_flow_imp_page.create_page(p_id=>10,p_name=>'Invoices',p_required_role=>wwv_flow_imp.id(5));
wwv_flow_imp_page.create_page_plug(p_id=>wwv_flow_imp.id(11),p_plug_name=>'List',p_plug_source=>wwv_flow_string.join(wwv_flow_t_varchar2('select * from invoices i','where i.person_id = :P10_PERSON')));
wwv_flow_imp_page.create_page_item(p_id=>wwv_flow_imp.id(12),p_name=>'P10_PERSON');
wwv_flow_imp_page.create_page_button(p_id=>wwv_flow_imp.id(13),p_button_name=>'GO',p_button_redirect_url=>'f?p=&APP_ID.:20:&SESSION.::NO::P20_ID:1');
wwv_flow_imp_page.create_page_process(p_id=>wwv_flow_imp.id(14),p_process_name=>'Save',p_process_sql_clob=>'begin update invoices set x = :P10_PERSON; note_pkg.say(1); commit; exception when others then null; end;',p_process_when_button_id=>wwv_flow_imp.id(13));
wwv_flow_imp_page.create_odd_thing(p_id=>1);
end;
/"""),
    ("f1/application/pages/page_00020.sql", "begin\nwwv_flow_imp.component_begin(p_default_application_id=>100);\nwwv_flow_imp_page.create_page(p_id=>20,p_name=>'One');\nwwv_flow_imp_page.create_page_plug(p_id=>wwv_flow_imp.id(21),p_plug_name=>'Again',p_plug_source=>'SELECT *  from invoices i where i.person_id = :P10_PERSON');\nend;\n/"),
]


def test_graph(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    g = application.application_graph(files)
    nodes = {r.id: r for r in g.nodes.collect()}
    edges = {(r.src, r.dst, r.type) for r in g.edges.collect()}
    kinds = lambda t: {(a, b) for a, b, k in edges if k == t}
    assert {n.name for n in nodes.values() if n.label == "Page"} == {"Invoices", "One"} and nodes["app:100"].name == "Shop"
    assert ("page:100:10", "reg:100:11") in kinds("CONTAINS_REGION") and ("page:100:10", "item:100:12") in kinds("CONTAINS_ITEM")
    assert kinds("NAVIGATES_TO") == {("btn:100:13", "page:100:20")} and kinds("SECURED_BY") == {("page:100:10", "authz:100:5")} and kinds("TRIGGERS") == {("btn:100:13", "proc:100:14")}
    sql = [n for n in nodes.values() if n.label == "SqlStatement"]
    regions = {a for a, b in kinds("EXECUTES_SQL") if nodes[b].name.startswith("select * from invoices")}
    assert regions == {"reg:100:11", "reg:100:21"} and any(n.props["selectStar"] == "true" for n in sql)
    block = [n for n in nodes.values() if n.label == "PlsqlBlock"][0]
    assert block.props["othersNull"] == "true" and (block.id, "unit:NOTE_PKG.SAY") in kinds("CALLS") and (block.id, "table:INVOICES") in kinds("WRITES_TO")
    assert ("reg:100:21", "item:100:12") in kinds("BINDS_ITEM")
    assert [(r.procedure, r.n) for r in application.unhandled(application.calls(files)).collect()] == [("create_odd_thing", 1)]


def test_urls(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([("f?p=&APP_ID.:20:&S.::NO::P20_ID,P20_X:1,2",), ("f?p=100:&P1_T.:x",)], "u string").select(application.url_page(F.col("u")).alias("p"), application.url_items(F.col("u")).alias("i")).collect()
    assert (r[0].p, r[0].i) == ("20", ["P20_ID", "P20_X"]) and r[1].p is None
