from inkprint.functions.stems import english_stems

# Published sample pairs of the algorithm.
PAIRS = """
consign consign consigned consign consigning consign consignment consign consist consist
consistency consist consistent consist consistently consist consists consist consolation consol
consolatory consolatori consoled consol consolidate consolid consolidated consolid consolingly consol
consonant conson conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirators conspir
conspire conspir constable constabl constancy constanc constant constant knackeries knackeri
knaves knave knavish knavish kneaded knead knees knee kneel kneel knightly knight knitted knit
knitting knit knives knive knocker knocker knots knot hopping hop hoping hope falling fall
ties tie cries cri gas gas gaps gap kiwis kiwi caresses caress agreed agre feed feed proceed proceed
generously generous general general generate generat communism communism skies sky dying die
by by say say cry cri happy happi enjoy enjoy relational relat conditional condit rational ration
vietnamization vietnam oscillator oscil fluently fluentli hopefulness hope formality formal
sensibility sensibl triplicate triplic adjustment adjust adoption adopt dependent depend
bowdlerize bowdler probate probat rate rate cease ceas controlled control rolling roll
youth youth boyish boyish sky sky news news inning inning
""".split()


def test_published_pairs(spark):
    expected = dict(zip(PAIRS[::2], PAIRS[1::2]))
    df = spark.createDataFrame([(w,) for w in expected] + [("It",), ("boy's",), ("'tis",)], "token string")
    got = {r["token"]: r["stem"] for r in english_stems(df).collect()}
    assert got.pop("It") == "it" and got.pop("boy's") == "boy" and got.pop("'tis") == "tis"
    assert got == expected
