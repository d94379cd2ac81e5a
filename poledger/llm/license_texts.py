"""Known licences as fixed values: full texts and the short notices that stand for a licence."""

from __future__ import annotations

from pathlib import Path

# Public licence texts.
_PERMIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE."
)
_USE_COPY = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_AUTHOR = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_REDISTRIBUTE = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEXTS = [
    ("MIT", f"{_PERMIT}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT", f"MIT License\n\n{_PERMIT}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT-0", f"{_PERMIT.removesuffix(', subject to the following conditions:')}.\n\n{_AS_IS}"),
    ("ISC", f"{_USE_COPY}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_AUTHOR}"),
    ("0BSD", f"{_USE_COPY}.\n\n{_AUTHOR}"),
    ("BSD-2-Clause", f"{_REDISTRIBUTE}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_REDISTRIBUTE}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]

# Titles that a full text may begin with.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "(The MIT License)", "License: MIT"],
    "MIT-0": ["MIT-0", "MIT No Attribution", "MIT No Attribution License"],
    "ISC": ["ISC", "ISC License", "The ISC License", "ISC License (ISC)", "ISC License (ISCL)"],
    "0BSD": ["0BSD", "BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License"],
    "BSD-2-Clause": ["BSD License", "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD License", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License"],
}
FILES = Path(__file__).with_name("license_files")  # full texts too long for this file, by id


def full_texts() -> list[tuple[str, str]]:
    """TEXTS, their full texts under every title, and the texts of FILES."""
    titled = [(i, f"{title}\n\n{text}") for i, text in TEXTS if "\n\n" in text for title in TITLES.get(i, [])]
    return [*TEXTS, *titled, *((f.stem, f.read_text("utf-8")) for f in sorted(FILES.glob("*.txt")))]


# Spellings that count as one, (as written, as compared).
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("per cent", "percent"),
    ("https", "http"), ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authoris", "authoriz"), ("cancelled", "canceled"), ("capitalis", "capitaliz"), ("catalogue", "catalog"),
    ("categoris", "categoriz"), ("centre", "center"), ("emphasis", "emphasiz"), ("favour", "favor"),
    ("fulfilment", "fulfillment"), ("initialis", "initializ"), ("judgement", "judgment"), ("labelled", "labeled"),
    ("maximis", "maximiz"), ("minimis", "minimiz"), ("non commercial", "noncommercial"), ("optimis", "optimiz"),
    ("organis", "organiz"), ("practise", "practice"), ("programme", "program"), ("realis", "realiz"),
    ("recognis", "recogniz"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
]
