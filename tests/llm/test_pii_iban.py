"""IBANs among upper-case words and digits."""

from sparkloom.llm import pii

DE, GB, NO = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"


def found(text):
    return [text[s:e] for k, s, e, _ in pii.find_spans(text) if k == "iban"]


def test_words_after_an_iban():
    for iban in (DE, GB, NO):
        for written in (iban, iban.replace(" ", "")):
            for after in ("", " is", " EUR 50", " BIC", " BIC COBADEFF", ".", " 12 34", " A B C D E F G H I J K L M N O P", " VERYLONGWORDOFUPPERCASELETTERSONLY"):
                for before in ("", "IBAN ", "AB12 ", "XY35 ON ACCOUNT "):
                    assert found(f"{before}{written}{after}") == [written], (before, written, after)


def test_several_and_none():
    assert found(f"{DE} {GB} {NO} EUR") == [DE, GB, NO]
    assert found(f"{DE.replace(' ', '')} {GB.replace(' ', '')}") == [DE.replace(" ", ""), GB.replace(" ", "")]
    assert found(DE[:-1] + "1 EUR 50") == [] and found("x" + DE) == [] and found(DE + "X") == []
    assert pii.redact(f"IBAN {DE} EUR 50") == "IBAN [IBAN] EUR 50"
