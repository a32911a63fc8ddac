"""Invented files for tests."""

import io
import zipfile
from email.message import EmailMessage

PNG = b"\x89PNG\r\n\x1a\n" + bytes(range(100))


def docx(*paragraphs, extra=""):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    xml = (
        '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/'
        f'wordprocessingml/2006/main"><w:body>{body}{extra}</w:body></w:document>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def eml(body="Hello", html=None, attachments=(), sender="Ada Example <ada@mail.example.com>", subject="Hi"):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = sender, "hr@example.com", subject
    if body is not None:
        m.set_content(body)
    if html is not None:
        if body is None:
            m.set_content(html, subtype="html")
        else:
            m.add_alternative(html, subtype="html")
    for name, data in attachments:
        if isinstance(data, EmailMessage):
            m.add_attachment(data)
        else:
            m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m


def package(**files):
    return package_of(files)


def package_of(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()
