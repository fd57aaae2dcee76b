"""Public licence texts, names for licence notices, and spellings that count as equal."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

TEXTS = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC),
    ("BSD-2-Clause", f"{BSD_START}\n\n{BSD_END}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{BSD_START}\n\n{BSD_END}"),
    ("BSD-3-Clause", f"{BSD_START}\n\n{BSD_NAMES}\n\n{BSD_END}"), ("BSD-3-Clause", f"BSD 3-Clause License\n\n{BSD_START}\n\n{BSD_NAMES}\n\n{BSD_END}"),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB),
    ("Apache-2.0", APACHE_HEADER),
]

# One-line notices are an opening and a name.
OPENINGS = ["", "Licensed under ", "Licensed under the ", "Released under ", "Released under the ", "Distributed under the ", "Available under the ",
            "This work is licensed under ", "This work is licensed under the ", "This software is licensed under the ",
            "This project is licensed under the ", "SPDX-License-Identifier: "]
NAMES = {
    "MIT": ["MIT", "MIT License", "The MIT License"],
    "ISC": ["ISC", "ISC License"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License"],
    "Zlib": ["Zlib", "zlib License"],
    "Apache-2.0": ["Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0"],
    "GPL-2.0": ["GPL-2.0", "GNU GPL v2", "GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GPL-3.0", "GNU GPL v3", "GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-3.0": ["LGPL-3.0", "GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["AGPL-3.0", "GNU Affero General Public License, version 3"],
    "MPL-2.0": ["MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "CC0-1.0": ["CC0-1.0", "CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC-BY-4.0", "CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0", "CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0", "CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
}

# Applied to words; the right side is the canonical one.
EQUAL_WORDS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("organisation", "organization"), ("organisations", "organizations"), ("recognised", "recognized"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("favour", "favor"), ("labour", "labor"), ("judgement", "judgment"),
    ("fulfil", "fulfill"), ("initialise", "initialize"), ("https", "http"),
]
EQUAL_PHRASES = [("non infringement", "noninfringement"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"),
                 ("and or", "andor"), ("per cent", "percent")]
# A year or a sign makes it a copyright line; a wrapped sentence may begin with the word too.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright\b[^\n]*[0-9]{4}|copyright[ \t]*(?:\(c\)|©|[\[<{])|\(c\)|©)[^\n]*"
NOT_A_WORD = r"[^\p{L}\p{N}]+"
