"""Notices and texts of licences: whole where they are short, else the passage that opens them."""

from __future__ import annotations

#: (licence, text), fixed values.
TEXTS: tuple[tuple[str, str], ...] = (
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    (
        "Apache-2.0",
        'TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions '
        'for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the '
        'copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union '
        "of the acting entity and all other entities that control, are controlled by, or are under common control with that entity. "
        'For the purposes of this definition, "control" means (i) the power, direct or indirect, to cause the direction or management '
        "of such entity, whether by contract or otherwise, or (ii) ownership of fifty percent (50%) or more of the outstanding shares, "
        'or (iii) beneficial ownership of such entity. "You" (or "Your") shall mean an individual or Legal Entity exercising '
        'permissions granted by this License. "Source" form shall mean the preferred form for making'
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
        "and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name "
        "of the University nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    (
        "GPL-3.0",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most "
        "software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU "
        "General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it "
        "remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our "
        "software; it applies also to any other work released this way by its authors. You can apply it to your programs, too. When we "
        "speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that "
        "you have the freedom to distribute copies of free software (and charge for them if you wish), that you"
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        'shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    (
        "MPL-2.0",
        '1. Definitions -------------- 1.1. "Contributor" means each individual or legal entity that creates, contributes to the '
        'creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if '
        "any) used by a Contributor and that particular Contributor's Contribution. 1.3. \"Contribution\" means Covered Software of a "
        'particular Contributor. 1.4. "Covered Software" means Source Code Form to which the initial Contributor has attached the '
        "notice in Exhibit A, the Executable Form of such Source Code Form, and Modifications of such Source Code Form, in each case "
        'including portions thereof. 1.5. "Incompatible With Secondary Licenses" means (a) that the initial Contributor has attached '
        "the notice described in Exhibit B to the Covered Software; or (b) that the Covered Software was made available under the "
        'terms of version 1.1 or earlier of the License, but not also under the terms of a Secondary License. 1.6. "Executable Form" '
        "means"
    ),
)
