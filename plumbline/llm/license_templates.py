"""Wording of common licences and of the notices and sentences that declare them."""

# Full texts and notices, without their copyright lines.
TEXTS = {
    "MIT": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

# The notices of the GNU licences, by what they cover and where the licence is to be had.
_GNU = """
This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License {terms}
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.
You should have received a copy of the GNU {kind}General Public License along with this {what}{where}"""
_GNU_TERMS = {
    "-or-later": ("as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.", "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."),
    "": ("version {} as published by the Free Software Foundation.", "as published by the Free Software Foundation, version {} of the License."),
}
_GNU_PLACES = (
    ". If not, see <https://www.gnu.org/licenses/>.",
    "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
)
#: Licence, its name between "GNU" and "General", version, what it covers.
_GNU_KINDS = (
    ("GPL-2.0", "", "2", ("program",)), ("GPL-3.0", "", "3", ("program",)),
    ("LGPL-2.1", "Lesser ", "2.1", ("library", "program")), ("LGPL-3.0", "Lesser ", "3", ("library", "program")), ("AGPL-3.0", "Affero ", "3", ("program",)),
)


def gnu_notices() -> list[tuple[str, str, tuple[str, ...]]]:
    """(licence, text, the phrases that tell it from its like) of the notices of the GNU licences."""
    return [
        (
            licence + later,
            _GNU.format(what=what, mark=":" if "see <" in where else ";", kind=kind, terms=terms.format(version), where=where).strip(),
            # The licence's own name and version, each with the word that follows in this wording.
            (f"GNU {kind}General Public License", f"version {version} {'as' if terms.startswith('version') else 'of'}") + (("any later version",) if later else ()),
        )
        for licence, kind, version, things in _GNU_KINDS
        for later, wordings in _GNU_TERMS.items()
        for terms in (wordings if not later else wordings[:1])
        for what in things
        for where in _GNU_PLACES
    ]


# Names under which licences are declared.
NAMES = {
    "MIT": ("the MIT License", "MIT License", "MIT"),
    "ISC": ("the ISC License", "ISC License"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License", "the BSD License"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU LGPL v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU LGPL v3", "LGPLv3"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPLv3"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "MPL 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    **{
        licence: (f"CC {code} 4.0", *(f"{article}Creative Commons {words} 4.0 {end}" for article in ("the ", "a ", "") for end in ("International License", "International", "License")))
        for licence, code, words in (
            ("CC-BY-4.0", "BY", "Attribution"),
            ("CC-BY-SA-4.0", "BY-SA", "Attribution-ShareAlike"),
            ("CC-BY-NC-4.0", "BY-NC", "Attribution-NonCommercial"),
            ("CC-BY-ND-4.0", "BY-ND", "Attribution-NoDerivatives"),
            ("CC-BY-NC-SA-4.0", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("CC-BY-NC-ND-4.0", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}
# Sentences that declare one.
SENTENCES = ("Licensed under {}", "Released under {}", "Distributed under {}", "Published under {}", "Available under {}", "This work is licensed under {}", "This project is licensed under {}", "SPDX-License-Identifier: {}")


def templates() -> list[tuple[str, str]]:
    """(licence, text): the texts, and every sentence with every name; SPDX identifiers stand for themselves."""
    made = [(licence, text.strip()) for licence, text in TEXTS.items()] + [(licence, text) for licence, text, _ in gnu_notices()]
    for licence, names in NAMES.items():
        made += [(licence, s.format(n)) for s in SENTENCES[:-1] for n in names]
        made.append((licence, SENTENCES[-1].format(licence)))
    return made


def phrases() -> dict[str, tuple[str, ...]]:
    """Of each template that declares a licence by its name: the name, which tells it from its like; of notices, name and version."""
    third = "Neither the name of", "endorse or promote products"
    return {text: own for _, text, own in gnu_notices()} | {TEXTS["BSD-3-Clause"].strip(): third} | {
        s.format(n): (f"{s.format('').split()[-1]} {n}" if " " not in n else n.removeprefix("the "),)
        for s in SENTENCES[:-1] for names in NAMES.values() for n in names
    } | {SENTENCES[-1].format(licence): (f"Identifier: {licence}",) for licence in NAMES}
