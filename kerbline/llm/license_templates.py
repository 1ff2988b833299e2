"""Licence templates: fixed values, the public wording of notices and licence paragraphs."""

#: (licence, template, wording)
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("MIT", "released", "Released under the MIT License."),
    ("MIT", "licensed", "Licensed under the MIT License."),
    ("Apache-2.0", "licensed", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "basis", "Unless required by applicable law or agreed to in writing, software distributed under the "
     "License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
     "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "work", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "program", "This program is free software: you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
     "your option) any later version."),
    ("GPL-2.0", "program", "This program is free software; you can redistribute it and/or modify it under the terms of the "
     "GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at "
     "your option) any later version."),
    ("LGPL-3.0", "work", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "form", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
     "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "licensed", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "licensed", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "licensed", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "work", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", "grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
     "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
     "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
     "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
     "THE SOFTWARE."),
    ("ISC", "grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met:"),
)
