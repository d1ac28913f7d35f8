from grammarlens.sources import dumps

LINE = "INSERT INTO `externallinks` VALUES (1,10,'https://a.example/(x),y','z',NULL),( 2 ,11,'mailto:a\\\\n\\'b','','null'),(3,,12,'no scheme'),(4,13,'ftp://c'"


def test_tuples_of_insert_lines(spark):
    rows = [(1, LINE), (2, "INSERT INTO `page` VALUES (1,0,'a:b');"), (3, None), (4, ""), (5, "-- INSERT INTO `externallinks` VALUES (1)"), (6, "INSERT INTO `externallinks` VALUES ();")]
    df = spark.createDataFrame(rows, "no int, value string").selectExpr("*", "9 as pos")
    got = {(r.no, r.pos): r.fields for r in dumps.tuples(df, "externallinks").collect()}
    assert got == {
        (1, 0): ["1", "10", "https://a.example/(x),y", "z", None],
        (1, 1): ["2", "11", "mailto:a\\n'b", "", "null"],
        (1, 2): ["3", "", "12", "no scheme"],
        (6, 0): [""],
    }
    assert [(r.pos, r.uri) for r in dumps.external_urls(df).collect()] == [(0, "https://a.example/(x),y"), (1, "mailto:a\\n'b")]
    assert dumps.external_urls(df, url_column=1).count() == 0
    assert dumps.external_urls(df, "page").collect()[0].uri == "a:b"
    assert dumps.tuples(df.where("false"), "page").count() == 0


def test_very_long_strings(spark):
    line = "INSERT INTO `t` VALUES " + ",".join(f"({i},'a:{'x' * 3000}\\'')" for i in range(500)) + ";"
    assert dumps.external_urls(spark.createDataFrame([(line,)], "value string"), "t", 1).count() == 500
