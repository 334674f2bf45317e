"""Integration files of both generations as a graph, and the links from it to database objects."""

import pytest

from quarrygraph.operators import links
from quarrygraph.sources import integration

FILES = [
    ("old/flows/Keep.process", "process5", """<pd:ProcessDefinition xmlns:pd="http://x/process"><pd:name>flows/Keep.process</pd:name>
<pd:starter name="Tick"><pd:type>com.x.plugin.timer.TimerEventSource</pd:type></pd:starter>
<pd:activity name="Find"><pd:type>com.x.plugin.jdbc.JDBCQueryActivity</pd:type><config><statement>select id from shop.invoices where x = %%Env/Limit%%</statement><jdbcSharedConfig>/res/Shop.sharedjdbc</jdbcSharedConfig></config></pd:activity>
<pd:activity name="Call"><pd:type>com.x.pe.core.CallProcessActivity</pd:type><config><processName>/flows/Send.process</processName></config></pd:activity>
<pd:transition><pd:from>Tick</pd:from><pd:to>Find</pd:to></pd:transition><pd:transition><pd:from>Find</pd:from><pd:to>Call</pd:to></pd:transition></pd:ProcessDefinition>"""),
    ("old/flows/Send.process", "process5", "<p><name>flows/Send.process</name><activity name='Gone'><type>x.CallProcess</type><processName>/else/Where.process</processName></activity><catch name='c'/></p>"),
    ("new/flow.bwp", "process6", """<b:process xmlns:b="urn:b" name="new.Flow"><b:flow><b:extensionActivity name="Put"><b:targets><b:target linkName="l"/></b:targets><cfg activityTypeID="bw.jdbc.update" sqlStatement="update invoices set a = 1" jdbcSharedResource="Shop"/></b:extensionActivity>
<b:receive name="Start" createInstance="yes"><b:sources><b:source linkName="l"/></b:sources></b:receive></b:flow><b:faultHandlers/></b:process>"""),
    ("old/res/Shop.sharedjdbc", "resource", "<jdbc name='Shop'><driver>d</driver><location>jdbc:x://host/shop</location><password>#!abc</password></jdbc>"),
    ("old/defaults/defaultVars.substvar", "variables", "<r><globalVariables><globalVariable><name>Env/Limit</name><value>5</value></globalVariable><globalVariable><name>Db/Password</name><value>p</value></globalVariable></globalVariables></r>"),
    ("new/o.xsd", "schema", "<s:schema xmlns:s='urn:s' targetNamespace='urn:o'><s:element name='order' type='t'/><s:element name='order'/><s:complexType name='t'/></s:schema>"),
    ("new/bad.bwp", "process6", "<not xml"),
]


@pytest.fixture(scope="module")
def graph(spark):
    g = integration.integration_graph(spark.createDataFrame(FILES, "path string, kind string, text string"))
    return {r.id: r for r in g.nodes.collect()}, [(e.src, e.dst, e.type) for e in g.edges.collect()]


def named(graph, kind):
    nodes, edges = graph
    return {(nodes[a].name, nodes[b].name) for a, b, t in edges if t == kind}


def test_graph(graph):
    nodes, _ = graph
    kinds = {}
    for n in nodes.values():
        kinds.setdefault(n.label, set()).add(n.name)
    assert kinds["Process"] == {"flows/Keep.process", "flows/Send.process", "new.Flow"} and kinds["SharedResource"] == {"Shop"} and kinds["SchemaElement"] == {"order"}
    assert named(graph, "TRANSITIONS_TO") == {("Tick", "Find"), ("Find", "Call"), ("Start", "Put")}
    assert named(graph, "INVOKES") == {("flows/Keep.process", "flows/Send.process"), ("flows/Send.process", "/else/Where.process")}
    assert named(graph, "CONFIGURED_BY") == {("Find", "Shop"), ("Put", "Shop")}
    assert named(graph, "READS_FROM") == {("Find", "INVOICES")} and named(graph, "WRITES_TO") == {("Put", "INVOICES")}
    assert named(graph, "USES_VARIABLE") == {("Find", "Env/Limit")}
    assert {n.props["category"] for n in nodes.values() if n.name in ("Find", "Put")} == {"DATABASE"}


def test_secrets(graph):
    text = str(graph)
    assert "#!abc" not in text and "***MASKED***" in text and [n for n in graph[0].values() if n.name == "Shop"][0].props["embeddedCredential"] == "true"


def test_links(spark):
    res = spark.createDataFrame([("r1", "Shop", "a/Shop", "jdbc:x://h/shop"), ("r2", "Feed", "a/Feed", "jdbc:y://feed"), ("r3", "Lost", "a/Lost", "")], "resource_id string, name string, qualified_name string, url string")
    entries = spark.createDataFrame([("Shop", "SHOP", None, 0), ("x", "FEED", "//feed", 1)], "resource string, schema string, url_contains string, position int")
    assert {(r.resource_id, r.schema) for r in links.map_datasources(res, entries).collect()} == {("r1", "SHOP"), ("r2", "FEED"), ("r3", None)}
    objects = spark.createDataFrame([("SHOP", "INVOICES", "db:SHOP.INVOICES", 1), ("FEED", "NOTES", "db:FEED.NOTES", 2), ("SHOP", "NOTES", "db:SHOP.NOTES", 3)], "owner string, name string, object_id string, ordinal long")
    names = spark.createDataFrame([("a1", "invoices", "READ", "SHOP"), ("a2", "invoices", "UPDATE", None), ("a3", "notes", "READ", None), ("a4", "nothing", "READ", "SHOP")], "source string, table string, access string, schema string")
    bound = links.bind_tables(names, objects)
    assert {(r.source, r.basis, r.reason) for r in bound.collect()} == {("a1", "qualified-name", None), ("a2", "name", None), ("a3", None, "ambiguous-name"), ("a4", None, "no-such-object")}
    edges, held, lost = links.cross_estate(bound)
    assert [(e.src, e.type) for e in edges.collect()] == [("a1", "READS_FROM")] and [h.src for h in held.collect()] == ["a2"] and lost.count() == 2
    acts = spark.createDataFrame([("a1", "p1", "Shop"), ("a2", "p1", None), ("a3", "p2", None)], "activity_id string, process_id string, resource string")
    refs = spark.createDataFrame([("p1", "a/Shop"), ("p2", "Shop"), ("p2", "Feed")], "process_id string, resource string")
    assert {(r.activity_id, r.resource_id) for r in links.bind_activities(acts, refs, res).collect()} == {("a1", "r1"), ("a2", "r1"), ("a3", None)}
