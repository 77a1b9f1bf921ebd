import pytest

from pyspark.sql import functions as F

from rosterlake.functions import stemming
from rosterlake.functions.text import tokens
from rosterlake.operators.text_index import TextIndex

# The examples that the published description gives for its rules, as whole words.
EXAMPLES = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil yes ye yellow yellow saying sai enjoyed enjoi by by is is
analogies analog possibly possibl""".split()


def test_published_examples(spark):
    words, want = EXAMPLES[::2], EXAMPLES[1::2]
    got = spark.createDataFrame([(words,)], "w array<string>").select(stemming.english(F.col("w"))).first()[0]
    assert [(w, g) for w, g in zip(words, got)] == list(zip(words, want))


@pytest.mark.parametrize("word", ["", "a", "λόγος", "über", "x1", "running2"])
def test_other_words_stay(spark, word):
    assert spark.createDataFrame([([word, None],)], "w array<string>").select(stemming.english(F.col("w"))).first()[0] == [word, None]


def test_index_finds_other_forms_of_a_word(spark, tmp_path):
    docs = spark.createDataFrame([(1, "They were connecting pipes"), (2, "a stone"), (3, "Connections and relations")], "doc_id long, text string")
    index = TextIndex(spark, str(tmp_path), buckets=2, analyse=lambda c: stemming.english(tokens(c)))
    index.update(docs, 1)
    found = index.search(spark.createDataFrame([(1, "connected")], "q long, t string"), "q", "t", 5).collect()
    assert {r.doc_id for r in found} == {1, 3}
