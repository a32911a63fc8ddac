"""The last headers are remembered; every message reads as it does under the default policy."""

import email
from email.policy import default

from builders import PNG, eml

from caseloom.sources import emails

ODD = [
    b"Content-Type: text/plain; charset=utf-8\nContent-Type: text/html\n\nbody",
    b"content-type: TEXT/html; charset=\"iso-8859-1\"\nContent-Transfer-Encoding: quoted-printable\n\n<p>j=F6rg</p>",
    b"Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Disposition: attachment; filename*=utf-8''j%C3%B6rg.txt\n\nx\n"
    b"--b\nContent-Type: message/rfc822\n\nSubject: j\xf6rg " + b"long " * 200 + b"\nContent-Type: text/plain\n\ninner\n--b\nContent-Disposition: attachment; filename=\"" + b"n" * 900 + b".txt\"\n\ny\n--b--\n",
    eml("für", attachments=[("a b.png", PNG), ("in.eml", eml("deep", attachments=[("c.txt", b"c")]).as_bytes())]).as_bytes(),
    b"Content-Type: \xff\xfe; x\n\nbody", b"",
]


def plain(monkeypatch, work):
    with monkeypatch.context() as m:
        m.setattr(emails, "_policy", default)
        return work()


def test_remembered_headers_change_nothing(monkeypatch):
    def read():
        return [(emails.decode_email(x), list(emails.attachments(x))) for x in ODD * 2]

    assert read() == plain(monkeypatch, read)
    assert 0 < len(emails._seen) <= emails.HEADERS and max(len(v) for _, v in emails._seen) <= emails.HEADER_CHARS


def test_a_header_is_parsed_once():
    message = email.message_from_bytes(b"Content-Type: application/x-once; a=1\n\nx", policy=emails._policy)
    assert message["Content-Type"] is message["Content-Type"] and message.get_content_type() == "application/x-once"
    for i in range(2 * emails.HEADERS):
        assert message.policy.header_fetch_parse("X-Number", str(i)) == str(i)
    assert len(emails._seen) <= emails.HEADERS
