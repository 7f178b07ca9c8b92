"""Stems of words whose stems are published, and of endings of every kind."""

import pytest
from pyspark.sql import functions as F

from attestry.functions import stemming

PAIRS = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist
consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir
conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee
knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skis ski skies sky dying die lying lie tying tie idly idl gently gentl ugly ugli early earli only onli singly singl sky sky news news howe howe atlas atlas cosmos cosmos bias bias andes andes
inning inning innings inning outing outing cannings canning herring herring earrings earring proceed proceed proceeds proceed exceed exceed succeed succeed succeeded succeed
generate generat generic generic generically generic general general communism communism community communiti arsenal arsenal arsenic arsenic
caresses caress ponies poni ties tie cries cri cats cat gas gas this this gaps gap kiwis kiwi us us bus bus
agreed agre feed feed plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file hoping hope hoped hope luxuriated luxuri
happy happi sky sky by by say say cry cri dyed dy
relational relat conditional condit rational ration valenci valenc digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper
feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative format formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism communism activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll
encryption encrypt encrypted encrypt encrypting encrypt encrypts encrypt keys key policies polici policy polici securely secur security secur authentication authent authenticated authent authorise authoris availability avail
backups backup databases databas yearly year youth youth boy boy boyish boyish day day flying fli universities univers
""".split()


def test_published_stems(spark):
    pairs = list(zip(PAIRS[::2], PAIRS[1::2], strict=True))
    rows = spark.createDataFrame([(w,) for w, _ in pairs], "word string").withColumn("stem", stemming.stem(F.col("word"))).collect()
    assert [(r["word"], r["stem"]) for r in rows if (r["word"], r["stem"]) not in pairs] == [] and len(rows) == len(pairs)


@pytest.mark.parametrize("word", ["1.2", "tls1.2", "ab", "x", "", "naïve", None])
def test_other_words_stay(spark, word):
    assert spark.createDataFrame([(word,)], "w string").select(stemming.stem(F.col("w"))).first()[0] == word


def test_words_are_stemmed_once_and_joined(spark):
    rows = spark.createDataFrame([(1, "keys"), (2, "keys"), (3, None), (4, "keyed")], "id int, word string")
    assert sorted((r["id"], r["stem"]) for r in stemming.with_stems(rows).collect()) == [(1, "key"), (2, "key"), (3, None), (4, "key")]
